"""Queries over tags and collections of items, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.functions import scalars as S
from marginalia.functions.text import is_known
from marginalia.operators import aggregate, paths, rules, search, sets
from marginalia.plans.items import _LATEST, _known, latest_items
from marginalia.sources.tables import read_table


def item_tags(spark: SparkSession, base: str) -> DataFrame:
    """(item_key, pos, tag, namespace, value): tags in order, repeats kept."""
    rows = latest_items(spark, base, ["tags_json"]).select("item_key", F.posexplode(S.known_strings("tags_json")).alias("pos", "tag"))
    return rows.select("item_key", "pos", "tag", S.tag_namespace("tag").alias("namespace"), S.tag_value("tag").alias("value"))


def item_collections(spark: SparkSession, base: str) -> DataFrame:
    """(item_key, collection_key): the bridge, without repeats."""
    rows = latest_items(spark, base, ["collections_json"]).select("item_key", F.explode(F.array_distinct(S.known_strings("collections_json"))).alias("collection_key"))
    return rows


def keyword_frequency(spark: SparkSession, base: str) -> DataFrame:
    """How often each tag is given, and whether it is a keyword (not a task tag, not numbered)."""
    counts = item_tags(spark, base).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("item_key").alias("n_items"))
    return counts.withColumn("kept", ~(F.col("tag").rlike(r"^(?:/unread|#.*|[A-Za-z]\..*|\d+\..*|topic/.*)$")))


def keyword_top(spark: SparkSession, base: str) -> DataFrame:
    """The hundred most frequent keywords: a top-k report."""
    return aggregate.top_k(keyword_frequency(spark, base).where("kept").select("tag", "n"), 100, "n", ["tag"])


def collection_members(spark: SparkSession, base: str) -> DataFrame:
    return item_collections(spark, base).groupBy("collection_key").agg(F.count_distinct("item_key").alias("n_items"))


def namespace_counts(spark: SparkSession, base: str) -> DataFrame:
    """Tags per collection and namespace, repeats of a tag counted."""
    joined = item_collections(spark, base).join(item_tags(spark, base), "item_key")
    return joined.groupBy("collection_key", "namespace").agg(F.count("*").alias("n_tags"), F.count_distinct("value").alias("n_values"))


def collection_overlap(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of collections with common items and their Jaccard share."""
    return aggregate.pair_overlap(item_collections(spark, base), "item_key", "collection_key")


def bridge_degree(spark: SparkSession, base: str) -> DataFrame:
    return aggregate.bridge_degree(collection_overlap(spark, base), 2)


def collection_evidence(spark: SparkSession, base: str) -> DataFrame:
    """Per collection: members, share with an abstract, share with text, share of topic tags."""
    members = item_collections(spark, base)
    items = latest_items(spark, base, ["abstract_note", "tags_json"]).select(
        "item_key",
        is_known("abstract_note").cast("double").alias("abstract"),
        F.size(F.filter(S.known_strings("tags_json"), lambda t: t.startswith("topic/"))).alias("topics"),
    )
    texts = read_table(spark, base, "pdf_extraction").where("status = 'ok'").select("item_key").distinct().withColumn("text", F.lit(1.0))
    joined = members.join(items, "item_key").join(texts, "item_key", "left")
    return joined.groupBy("collection_key").agg(
        F.count("*").alias("n_items"),
        F.avg("abstract").alias("abstract_rate"),
        F.avg(F.coalesce("text", F.lit(0.0))).alias("text_rate"),
        (F.sum("topics") / F.count("*")).alias("topics_per_item"),
    )


def collection_score(spark: SparkSession, base: str) -> DataFrame:
    """Weighted score of a collection: size on a root scale, bridges up to a cap, evidence."""
    evidence, bridges = collection_evidence(spark, base), bridge_degree(spark, base)
    total = latest_items(spark, base, []).agg(F.count("*").alias("n_all"))
    joined = evidence.join(bridges, evidence.collection_key == bridges.value, "left").withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    score = 10 * F.sqrt("n_items") / F.sqrt("n_all") + F.least(F.coalesce("degree", F.lit(0)), F.lit(12)) / 12 * 3 + F.col("text_rate") * 2
    scored = joined.select("collection_key", "n_items", F.coalesce("degree", F.lit(0)).alias("degree"), F.round(score, 9).alias("score"))
    return scored.withColumn("tier", F.when(F.col("score") >= 4, "core").when(F.col("score") >= 3, "wide").when(F.col("score") >= 2, "narrow").otherwise("edge"))


def top_tags_of_collections(spark: SparkSession, base: str) -> DataFrame:
    counts = item_collections(spark, base).join(item_tags(spark, base).select("item_key", "value"), "item_key").groupBy("collection_key", "value").agg(F.count("*").alias("n"))
    return aggregate.top_per_group(counts, ["collection_key"], "value", "n", 8)


def tag_entropy(spark: SparkSession, base: str) -> DataFrame:
    """How evenly a tag is spread over the library's publications."""
    venues = latest_items(spark, base, ["publication"]).select("item_key", S.first_known("publication").alias("venue")).where("venue <> ''")
    counts = item_tags(spark, base).join(venues, "item_key").groupBy("tag", "venue").agg(F.count("*").alias("n"))
    return aggregate.normalized_entropy(counts, ["tag"], "n").withColumn("entropy", F.round("entropy", 9))


TAG_ACTIONS_LEAST = 20


def tag_actions(spark: SparkSession, base: str) -> DataFrame:
    """What becomes of each tag: long tail dropped, case variants mapped to the commonest spelling, others kept."""
    counts = item_tags(spark, base).groupBy("namespace", "value").agg(F.count("*").alias("n"))
    keyed = counts.withColumn("token", F.lower(F.regexp_replace("value", r"[\s_-]+", "")))
    canonical = keyed.groupBy("namespace", "token").agg(F.max(F.struct(F.col("n"), F.col("value"))).alias("best"), F.sum("n").alias("total"), F.count("*").alias("n_spellings"))
    joined = keyed.join(canonical, ["namespace", "token"])
    action = F.when(F.col("total") < TAG_ACTIONS_LEAST, "drop_long_tail").when(F.col("value") != F.col("best.value"), "map_to_canonical").otherwise("keep")
    return joined.select("namespace", "value", "n", F.col("best.value").alias("canonical"), "total", "n_spellings", action.alias("action"))


def taxonomy(spark: SparkSession, base: str) -> DataFrame:
    """Per namespace: values, uses, items, and the most used values."""
    tags = item_tags(spark, base)
    sums = tags.groupBy("namespace").agg(F.count_distinct("value").alias("n_values"), F.count("*").alias("n_tags"), F.count_distinct("item_key").alias("n_items"))
    top = aggregate.top_per_group(tags.groupBy("namespace", "value").agg(F.count("*").alias("n")), ["namespace"], "value", "n", 12)
    return sums.join(top, "namespace")


def limited_tags(spark: SparkSession, base: str) -> DataFrame:
    """The first two distinct tags of each namespace of an item, in the order they were given."""
    firsts = item_tags(spark, base).groupBy("item_key", "namespace", "value").agg(F.min("pos").alias("pos"))
    ranked = firsts.withColumn("place", F.row_number().over(Window.partitionBy("item_key", "namespace").orderBy("pos")))
    return ranked.where("place <= 2").select("item_key", "namespace", "place", "value")


def tag_statistics(spark: SparkSession, base: str) -> DataFrame:
    """Distribution of tags per item."""
    sizes = latest_items(spark, base, ["tags_json"]).select(F.size(S.known_strings("tags_json")).alias("n_tags"))
    return sizes.groupBy("n_tags").agg(F.count("*").alias("n_items"))


RULES: rules.Rules = [
    ("object", "Dwellings", ["dwelling", "dormitory", "house"]),
    ("object", "Schools", ["school", "lecture", "classroom"]),
    ("object", "Transport", ["airport", "railway"]),
    ("method", "Statistics", ["regression", "Bayesian", "factorial"]),
    ("method", "Simulation", ["simulation", "transient solver", "zonal model"]),
    ("method", "Survey", ["survey", "questionnaire", "interview"]),
    ("topic", "Radiant systems", ["radiant", "chilled beam", "辐射"]),
    ("topic", "Carbon", ["carbon", "碳排"]),
]


def classified_items(spark: SparkSession, base: str) -> DataFrame:
    """Rules that items meet by title, abstract, venue and tags, with the first keyword met."""
    items = search.not_deleted(latest_items(spark, base, ["title", "abstract_note", "publication", "tags_json", "zotero_deleted"]))
    blob = S.text_blob("title", "abstract_note", "publication", F.array_join(S.known_strings("tags_json"), " "))
    return rules.rule_hits(items, "item_key", blob, RULES)


def classification_plan(spark: SparkSession, base: str) -> DataFrame:
    """Recommended tags of each item and whether it must be looked at."""
    hits = classified_items(spark, base).groupBy("item_key").agg(F.collect_set(F.concat_ws("/", "rule_group", S.slug("rule_name"))).alias("met"))
    items = search.not_deleted(latest_items(spark, base, ["zotero_deleted"])).select("item_key").join(hits, "item_key", "left")
    tags = sets.sorted_distinct(F.concat(F.array(F.lit("read/todo")), F.coalesce("met", F.array().cast("array<string>"))))
    return items.select("item_key", F.array_join(tags, "; ").alias("recommended"), F.col("met").isNull().alias("review"))


def rule_choice(spark: SparkSession, base: str) -> DataFrame:
    """The first rule that each tag value meets."""
    values = item_tags(spark, base).groupBy("value").agg(F.count("*").alias("n"))
    return values.select("value", "n", rules.first_rule(F.lower("value"), [(name, ks) for _, name, ks in RULES], "Other").alias("family"))


TOPICS = [("T1", "radiant"), ("T2", "gradient"), ("T3", "carbon"), ("method/field survey", "survey")]


def topic_partitions(spark: SparkSession, base: str) -> DataFrame:
    """Items per topic; an item may be in several, or in none."""
    items = latest_items(spark, base, ["tags_json"])
    return rules.topics_of(items, "item_key", S.known_strings("tags_json"), TOPICS).groupBy("topic").agg(F.count("*").alias("n_items"))


def set_plans(spark: SparkSession, base: str) -> DataFrame:
    """Plans for an item's collections: union, additive append, removal, what is missing, blockers."""
    items = latest_items(spark, base, ["collections_json", "tags_json"])
    now, wanted = S.known_strings("collections_json"), F.transform(F.slice(S.known_strings("tags_json"), 1, 2), lambda t: F.upper(t))
    gone = F.slice(now, 1, 1)
    show = lambda a: F.array_join(a, "; ")
    return items.select(
        "item_key",
        show(sets.union_keep_order(now, wanted)).alias("union_plan"),
        show(sets.append_missing(now, wanted)).alias("append_plan"),
        show(sets.remove(now, gone)).alias("remove_plan"),
        show(sets.missing(wanted, now)).alias("missing_plan"),
        (F.size(sets.missing(wanted, now)) > 0).alias("incomplete"),
        show(sets.sorted_distinct(F.concat(now, wanted))).alias("sorted_plan"),
        F.arrays_overlap(now, gone).alias("overlaps"),
    )


def collection_paths(spark: SparkSession, base: str) -> DataFrame:
    """Paths of collections by walking up; a missing parent gives its key, a cycle ends where it closes."""
    from marginalia.operators.hierarchy import latest_links
    from marginalia.session import cut_lineage

    rows = read_table(spark, base, "collections")
    links = latest_links(rows).select("node", "name")
    parents = rows.select(F.trim("collection_key").alias("node"), "last_seen_at", F.trim(F.regexp_replace("parent_key", r"\s+", "")).alias("parent"))
    latest = parents.groupBy("node").agg(F.max(F.struct("last_seen_at", "parent")).alias("s")).select("node", F.col("s.parent").alias("parent"))
    joined = links.join(latest, "node").select("node", F.when(F.col("parent").isin("", "false"), None).otherwise(F.col("parent")).alias("parent"), "name")
    return paths.walk_up(cut_lineage(joined)).select(F.col("node").alias("collection_key"), "path")


def path_scope(spark: SparkSession, base: str) -> DataFrame:
    """How many stored paths lie at or below each top-level path."""
    stored = read_table(spark, base, "collections").where("path IS NOT NULL").select("path").distinct()
    tops = stored.where(~F.col("path").contains("/")).select(F.col("path").alias("root"))
    first = stored.withColumn("root", F.substring_index("path", "/", 1))
    return first.join(tops, "root").where(paths.under(F.col("path"), F.col("root"))).groupBy("root").agg(F.count("*").alias("n_paths"))


def missing_paths(spark: SparkSession, base: str) -> DataFrame:
    """Prefixes of the paths on items that no collection has."""
    wanted = latest_items(spark, base, ["collection_paths_json"]).select(F.explode(S.known_strings("collection_paths_json")).alias("path")).distinct()
    held = read_table(spark, base, "collections").where("path IS NOT NULL").select("path")
    return paths.missing_prefixes(wanted, held)


def path_rollup(spark: SparkSession, base: str) -> DataFrame:
    """Items at or below each path prefix: a roll-up of the hierarchy."""
    links = latest_items(spark, base, ["collection_paths_json"]).select("item_key", F.explode(F.array_distinct(S.known_strings("collection_paths_json"))).alias("path"))
    spread = links.select("item_key", F.explode(paths.prefixes(F.col("path"))).alias("path")).distinct()
    return spread.groupBy("path").agg(F.count("*").alias("n_items"))


QUERIES = {
    f.__name__: f
    for f in (
        item_tags, item_collections, keyword_frequency, keyword_top, collection_members, namespace_counts, collection_overlap, bridge_degree, collection_evidence,
        collection_score, top_tags_of_collections, tag_entropy, tag_actions, taxonomy, limited_tags, tag_statistics, classified_items, classification_plan,
        rule_choice, topic_partitions, set_plans, collection_paths, path_scope, missing_paths, path_rollup,
    )
}

_TAGS = (
    "WITH "
    + _LATEST
    + r""",
    tags AS (SELECT item_key, pos, tag, CASE WHEN contains(tag, '/') THEN regexp_replace(string_split(tag, '/')[1], '^#', '') ELSE '' END AS namespace,
               trim(CASE WHEN contains(tag, '/') THEN regexp_replace(tag, '^[^/]*/', '') ELSE tag END) AS value
             FROM (SELECT item_key, unnest(tags) AS tag, CAST(unnest(range(len(tags))) AS INTEGER) AS pos FROM listed)),
    links AS (SELECT DISTINCT item_key, unnest(collections) AS collection_key FROM listed)
"""
)
_FREQUENCY = r"""
    frequency AS (SELECT tag, count(*) AS n, count(DISTINCT item_key) AS n_items, NOT regexp_full_match(tag, '/unread|#.*|[A-Za-z]\..*|[0-9]+\..*|topic/.*') AS kept FROM tags GROUP BY tag)
"""
_OVERLAP = """
    sizes AS (SELECT collection_key, count(*) AS n FROM links GROUP BY collection_key),
    overlap AS (SELECT l AS left_value, r AS right_value, n_both, a.n AS n_left, b.n AS n_right, n_both / (a.n + b.n - n_both) AS jaccard
      FROM (SELECT a.collection_key AS l, b.collection_key AS r, count(*) AS n_both FROM links a JOIN links b ON a.item_key = b.item_key AND a.collection_key < b.collection_key GROUP BY ALL)
      JOIN sizes a ON a.collection_key = l JOIN sizes b ON b.collection_key = r),
    bridges AS (SELECT value, count(*) AS degree FROM (SELECT unnest([left_value, right_value]) AS value FROM overlap WHERE n_both >= 2) GROUP BY value)
"""
_EVIDENCE = f"""
    evidence AS (SELECT k.collection_key, count(*) AS n_items, avg(CAST({_known("l.abstract_note")} AS DOUBLE)) AS abstract_rate,
        avg(CASE WHEN x.item_key IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS text_rate, sum(len(list_filter(t.tags, lambda y: starts_with(y, 'topic/')))) / count(*) AS topics_per_item
      FROM links k JOIN latest l ON l.item_key = k.item_key JOIN listed t ON t.item_key = k.item_key
      LEFT JOIN (SELECT DISTINCT item_key FROM pdf_extraction WHERE status = 'ok') x ON x.item_key = k.item_key GROUP BY k.collection_key)
"""


def _case(blob: str) -> str:
    hits = []
    for group, name, keywords in RULES:
        hit = "CASE " + " ".join(f"WHEN contains({blob}, '{k.lower()}') THEN '{k}'" for k in keywords) + " END"
        hits.append(f"SELECT item_key, '{group}' AS rule_group, '{name}' AS rule_name, {hit} AS keyword FROM blobs")
    return " UNION ALL ".join(hits)


_HITS = f"""
    blobs AS (SELECT l.item_key, lower(concat_ws(' ', nullif(title, ''), nullif(abstract_note, ''), nullif(publication, ''), nullif(array_to_string(t.tags, ' '), ''))) AS blob
      FROM latest l JOIN listed t ON t.item_key = l.item_key WHERE coalesce(zotero_deleted, 0) = 0),
    hits AS (SELECT * FROM ({_case("blob")}) WHERE keyword IS NOT NULL)
"""
_FAMILY = "CASE " + " ".join(f"WHEN contains(lower(value), '{k.lower()}') THEN '{name}'" for _, name, ks in RULES for k in ks) + " ELSE 'Other' END"
_TOPIC = "[" + ", ".join(f"CASE WHEN contains(lower(array_to_string(tags, '; ')), '{label}') OR list_contains(tags, '{code}') THEN '{code}' END" for code, label in TOPICS) + "]"
_PREFIXES = "list_transform(range(1, len(string_split(path, '/')) + 1), lambda n: array_to_string(list_slice(string_split(path, '/'), 1, n), '/'))"
_WANTED = """
    wanted AS (SELECT item_key, unnest(list_filter(list_transform(from_json(CASE WHEN json_valid(collection_paths_json) AND json_type(collection_paths_json) = 'ARRAY' THEN collection_paths_json END, '["VARCHAR"]'), lambda x: trim(x)), lambda x: x <> '')) AS path FROM latest)
"""
_TOP8 = "array_to_string(list(value || ' (' || n || ')' ORDER BY place), '; ')"

ORACLES = {
    "item_tags": _TAGS + " SELECT * FROM tags",
    "item_collections": _TAGS + " SELECT * FROM links",
    "keyword_frequency": _TAGS + "," + _FREQUENCY + " SELECT * FROM frequency",
    "keyword_top": _TAGS + "," + _FREQUENCY + " SELECT tag, n FROM frequency WHERE kept ORDER BY n DESC, tag LIMIT 100",
    "collection_members": _TAGS + " SELECT collection_key, count(DISTINCT item_key) AS n_items FROM links GROUP BY collection_key",
    "namespace_counts": _TAGS + " SELECT collection_key, namespace, count(*) AS n_tags, count(DISTINCT value) AS n_values FROM links JOIN tags USING (item_key) GROUP BY collection_key, namespace",
    "collection_overlap": _TAGS + "," + _OVERLAP + " SELECT * FROM overlap",
    "bridge_degree": _TAGS + "," + _OVERLAP + " SELECT * FROM bridges",
    "collection_evidence": _TAGS + "," + _EVIDENCE + " SELECT * FROM evidence",
    "collection_score": _TAGS
    + ","
    + _OVERLAP
    + ","
    + _EVIDENCE
    + """ SELECT *, CASE WHEN score >= 4 THEN 'core' WHEN score >= 3 THEN 'wide' WHEN score >= 2 THEN 'narrow' ELSE 'edge' END AS tier FROM (
      SELECT collection_key, n_items, coalesce(degree, 0) AS degree, round(10 * sqrt(n_items) / sqrt((SELECT count(*) FROM latest)) + least(coalesce(degree, 0), 12) / 12 * 3 + text_rate * 2, 9) AS score
      FROM evidence LEFT JOIN bridges ON value = collection_key)""",
    "top_tags_of_collections": _TAGS
    + f""" SELECT collection_key, {_TOP8} AS top FROM (SELECT *, row_number() OVER (PARTITION BY collection_key ORDER BY n DESC, value) AS place FROM (
      SELECT collection_key, value, count(*) AS n FROM links JOIN tags USING (item_key) GROUP BY collection_key, value)) WHERE place <= 8 GROUP BY collection_key""",
    "tag_entropy": _TAGS
    + f""" SELECT tag, CAST(total AS BIGINT) AS total, kinds, round(CASE WHEN kinds > 1 THEN (ln(total) - s / total) / ln(kinds) ELSE 0 END, 9) AS entropy FROM (
      SELECT tag, sum(n) AS total, count(*) AS kinds, sum(n * ln(n)) AS s FROM (SELECT tag, trim(publication) AS venue, count(*) AS n FROM tags JOIN latest USING (item_key) WHERE {_known("publication")} GROUP BY ALL) GROUP BY tag)""",
    "tag_actions": _TAGS
    + rf""", counted AS (SELECT namespace, value, count(*) AS n, lower(regexp_replace(value, '[\s_-]+', '', 'g')) AS token FROM tags GROUP BY ALL)
      SELECT namespace, value, n, canonical, CAST(total AS BIGINT) AS total, n_spellings, CASE WHEN total < {TAG_ACTIONS_LEAST} THEN 'drop_long_tail' WHEN value <> canonical THEN 'map_to_canonical' ELSE 'keep' END AS action
      FROM counted JOIN (SELECT namespace, token, arg_max(value, (n, value)) AS canonical, sum(n) AS total, count(*) AS n_spellings FROM counted GROUP BY ALL) USING (namespace, token)""",
    "taxonomy": _TAGS
    + f""" SELECT * FROM (SELECT namespace, count(DISTINCT value) AS n_values, count(*) AS n_tags, count(DISTINCT item_key) AS n_items FROM tags GROUP BY namespace)
      JOIN (SELECT namespace, {_TOP8} AS top FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY n DESC, value) AS place FROM (SELECT namespace, value, count(*) AS n FROM tags GROUP BY ALL)) WHERE place <= 12 GROUP BY namespace) USING (namespace)""",
    "limited_tags": _TAGS
    + """ SELECT item_key, namespace, CAST(place AS INTEGER) AS place, value FROM (SELECT *, row_number() OVER (PARTITION BY item_key, namespace ORDER BY pos) AS place FROM (
      SELECT item_key, namespace, value, min(pos) AS pos FROM tags GROUP BY ALL)) WHERE place <= 2""",
    "tag_statistics": _TAGS + " SELECT CAST(len(tags) AS INTEGER) AS n_tags, count(*) AS n_items FROM listed GROUP BY ALL",
    "classified_items": "WITH " + _LATEST + "," + _HITS + " SELECT * FROM hits",
    "classification_plan": "WITH "
    + _LATEST
    + ","
    + _HITS
    + r""" SELECT item_key, array_to_string(list_sort(list_distinct(list_append(coalesce(met, []), 'read/todo'))), '; ') AS recommended, met IS NULL AS review FROM latest
      LEFT JOIN (SELECT item_key, list(rule_group || '/' || trim(regexp_replace(lower(rule_name), '[^a-z0-9]+', '-', 'g'), '-')) AS met FROM hits GROUP BY item_key) USING (item_key) WHERE coalesce(zotero_deleted, 0) = 0""",
    "rule_choice": _TAGS + f" SELECT value, n, {_FAMILY} AS family FROM (SELECT value, count(*) AS n FROM tags GROUP BY value)",
    "topic_partitions": "WITH "
    + _LATEST
    + f""" SELECT topic, count(*) AS n_items FROM (SELECT unnest(CASE WHEN len(found) = 0 THEN ['UNCLASSIFIED'] ELSE found END) AS topic FROM (
      SELECT list_filter({_TOPIC}, lambda x: x IS NOT NULL) AS found FROM listed)) GROUP BY topic""",
    "missing_paths": "WITH "
    + _LATEST
    + ","
    + _WANTED
    + f""" SELECT path, CAST(length(path) - length(replace(path, '/', '')) AS INTEGER) AS depth FROM (SELECT DISTINCT unnest({_PREFIXES}) AS path FROM wanted)
      WHERE path NOT IN (SELECT path FROM collections WHERE path IS NOT NULL)""",
    "path_scope": """SELECT root, count(*) AS n_paths FROM (SELECT DISTINCT path, string_split(path, '/')[1] AS root FROM collections WHERE path IS NOT NULL)
      WHERE root IN (SELECT path FROM collections WHERE path IS NOT NULL) GROUP BY root""",
    "path_rollup": "WITH " + _LATEST + "," + _WANTED + f" SELECT path, count(DISTINCT item_key) AS n_items FROM (SELECT item_key, unnest({_PREFIXES}) AS path FROM wanted) GROUP BY path",
    "set_plans": "WITH "
    + _LATEST
    + r""" SELECT item_key, array_to_string(list_concat(dnow, list_filter(dwanted, lambda x: NOT list_contains(dnow, x))), '; ') AS union_plan,
      array_to_string(list_concat(now, list_filter(dwanted, lambda x: NOT list_contains(now, x))), '; ') AS append_plan,
      array_to_string(list_filter(now, lambda x: NOT list_contains(now[1:1], x)), '; ') AS remove_plan,
      array_to_string(list_filter(dwanted, lambda x: NOT list_contains(now, x)), '; ') AS missing_plan,
      len(list_filter(dwanted, lambda x: NOT list_contains(now, x))) > 0 AS incomplete,
      array_to_string(list_sort(list_distinct(list_concat(now, wanted))), '; ') AS sorted_plan, len(now) > 0 AS overlaps
      FROM (SELECT item_key, collections AS now, list_transform(tags[1:2], lambda x: upper(x)) AS wanted,
              list_transform(list_filter(list_zip(collections, range(1, len(collections) + 1)), lambda z: list_position(collections, z[1]) = z[2]), lambda z: z[1]) AS dnow,
              list_transform(list_filter(list_zip(tags[1:2], range(1, len(tags[1:2]) + 1)), lambda z: list_position(tags[1:2], z[1]) = z[2]), lambda z: upper(z[1])) AS dwanted FROM listed)""",
    "collection_paths": r"""
      WITH RECURSIVE latest AS (
        SELECT trim(collection_key, e' \t\n\r') AS node, name, trim(parent_key, e' \t\n\r') AS parent,
               row_number() OVER (PARTITION BY trim(collection_key, e' \t\n\r') ORDER BY last_seen_at DESC NULLS LAST, name DESC NULLS LAST, trim(parent_key, e' \t\n\r') DESC NULLS LAST) AS place FROM collections),
      links AS (SELECT node, CASE WHEN parent IN ('', 'false') THEN NULL ELSE parent END AS parent, CASE WHEN trim(coalesce(name, '')) = '' THEN node ELSE name END AS name FROM latest WHERE place = 1),
      up AS (
        SELECT node, parent AS at_node, name AS path, [node] AS seen, 0 AS steps FROM links
        UNION ALL
        SELECT u.node, l.parent, coalesce(l.name, u.at_node) || '/' || u.path, list_append(u.seen, u.at_node), u.steps + 1 FROM up u LEFT JOIN links l ON l.node = u.at_node
        WHERE u.at_node IS NOT NULL AND NOT list_contains(u.seen, u.at_node))
      SELECT node AS collection_key, arg_max(path, steps) AS path FROM up GROUP BY node""",
}
