"""Freely typed values mapped to a reference list by a partition-based pigeonhole join.

Every reference string (the *aliases* of an entry) is cut into k + 1 segments. A typed string within
edit distance k of it must hold at least one segment unchanged, moved by no more characters than the
edits before and after it allow, so an equality join on (length, k, segment, substring) finds every
pair within k edits. Pairs are verified with the built-in ``levenshtein``; what no pair reaches is
found by an anti-join and reported as ``unmatched``. Everything is Spark SQL.

Defined results: null or placeholder values are no case; empty tables give no rows (an empty list
gives ``unmatched`` for every case); repeated rows count once; of several entries at the same
distance the one named by the row's abbreviation wins, else the first by code point; further columns
of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.functions.sql import sql as named_sql
from marginalia.functions.text import is_known, journal_key, trim_ws
from marginalia.llm.scripts import simplifying
from marginalia.session import cut_lineage

UNMATCHED = "unmatched"

#: Words that carry no meaning in a title.
STOP = "'of','in','on','and','the','for'"

HAN = r"\p{IsHan}"


def sql(spark: SparkSession, text: str, **names) -> DataFrame:
    return named_sql(spark, text, STOP=STOP, HAN=HAN, **names)


#: Characters of the first and last part of an unspaced title, at most.
PART = 4


def title_parts(titles: DataFrame) -> DataFrame:
    """(title, place, subject, sort_of) of unspaced ``titles(title)``: cut where what may stand beside a part varies.

    A part that many titles share, and that different characters follow (or precede, at the end), is a word
    of its own; one character more or less and the next one is nearly fixed. Where a part occurs once only,
    the length that most titles have counts. Titles that are too short for three parts are left out.
    """
    return sql(
        titles.sparkSession,
        r"""
        WITH cuts AS (
          SELECT title, side, k, IF(side = 'head', left(title, k), right(title, k)) AS part, IF(side = 'head', substr(title, k + 1, 1), substr(title, length(title) - k, 1)) AS beside
          FROM (SELECT title, side, explode(sequence(1, least({PART}, length(title) - 2))) AS k FROM (SELECT DISTINCT title FROM {t} WHERE length(title) >= 3) CROSS JOIN VALUES ('head'), ('tail') AS sides(side))),
        varied AS (SELECT side, part, count(DISTINCT beside) AS variety FROM cuts GROUP BY side, part),
        -- the first part with more beside it than the next longer one has; a whole subject with its kind may be shared, too
        best AS (
          SELECT title, side, min(IF(variety > 1 AND variety > coalesce(longer, 0), k, NULL)) AS k
          FROM (SELECT title, side, k, variety, lead(variety) OVER (PARTITION BY title, side ORDER BY k) AS longer FROM cuts JOIN varied USING (side, part)) GROUP BY title, side),
        usual AS (SELECT side, mode(k, true) AS k FROM best WHERE k IS NOT NULL GROUP BY side),
        chosen AS (SELECT title, side, coalesce(b.k, u.k) AS k FROM best b JOIN usual u USING (side))
        SELECT title, left(title, a) AS place, substr(title, a + 1, length(title) - a - z) AS subject, right(title, z) AS sort_of
        FROM (SELECT title, max(IF(side = 'head', k, NULL)) AS a, max(IF(side = 'tail', k, NULL)) AS z FROM chosen GROUP BY title) WHERE a + z < length(title)""",
        t=titles,
        PART=PART,
    )


def _han_titles(rankings: DataFrame) -> DataFrame:
    """(entry, title, other) of the rows with a title in Han script, the title without blanks and signs."""
    return sql(
        rankings.sparkSession,
        r"""
        SELECT normalized_name AS entry, regexp_replace(lower(journal_name), r'[^\p{L}\p{N}_]+', '') AS title, source_query AS other
        FROM {r} WHERE journal_name RLIKE r'{HAN}'""",
        r=rankings,
    )


def _aliases(listed: DataFrame, rankings: DataFrame, cut: DataFrame) -> DataFrame:
    """(entry, alias, kind, words): every string under which an entry may be typed; ``cut`` holds the parts of unspaced titles."""
    spark = listed.sparkSession
    # the words of a title; of a Chinese one its place, subject and kind are the parts
    parts = sql(
        spark,
        r"""
        SELECT normalized_name AS entry, status, journal_name AS title, source_query AS other,
               journal_name RLIKE r'{HAN}' AS han,
               filter(split(lower(journal_name), r'[^\p{L}\p{N}_-]+'), w -> w <> '' AND w NOT IN ({STOP})) AS words,
               filter(split(lower(source_query), r'[^\p{L}\p{N}_-]+'), w -> w <> '' AND w NOT IN ({STOP})) AS others
        FROM {r} WHERE journal_name IS NOT NULL""",
        r=rankings,
    )
    # short forms of single words, learned where the list itself gives a title in short form
    short = sql(
        spark,
        r"""
        SELECT p.x.words AS word, min(p.x.others) AS short FROM (
          SELECT explode(arrays_zip(words, others)) AS x FROM {p}
          WHERE NOT han AND other LIKE '%.%' AND size(words) = size(others)) p
        WHERE startswith(p.x.words, p.x.others) GROUP BY p.x.words""",
        p=parts,
    )
    latin = sql(
        spark,
        r"""
        SELECT entry, title, pos, word, coalesce(short, substr(word, 1, 4)) AS short
        FROM (SELECT entry, title, posexplode(words) AS (pos, word) FROM {p} WHERE status = 'ok' AND NOT han)
        LEFT JOIN {s} USING (word)""",
        p=parts,
        s=short,
    )
    titles = sql(
        spark,
        r"""
        SELECT entry, transform(xs, x -> x.word) AS words, transform(xs, x -> x.short) AS shorts
        FROM (SELECT entry, array_sort(collect_list(struct(pos, word, short))) AS xs FROM {l} GROUP BY entry)""",
        l=latin,
    )
    # English names of Chinese titles, composed from the parts of those names that the list gives
    han = sql(spark, "SELECT entry, title, place, subject, sort_of, other FROM {h} JOIN {cut} USING (title)", h=_han_titles(rankings), cut=cut)
    both = sql(
        spark,
        r"""
        SELECT place, subject, sort_of, split(lower(trim(other)), ' +') AS w FROM {h}
        WHERE other RLIKE r'^[A-Za-z -]+$' AND size(split(trim(other), ' +')) >= 3""",
        h=han,
    )
    composed = sql(
        spark,
        r"""
        SELECT h.entry, concat_ws(' ', a.v, b.v, c.v) AS name FROM {h} h
        JOIN {listed} USING (entry)
        JOIN (SELECT place, min(w[0]) AS v FROM {both} GROUP BY place) a ON h.place = a.place
        JOIN (SELECT subject, min(array_join(slice(w, 2, size(w) - 2), ' ')) AS v FROM {both} GROUP BY subject) b ON h.subject = b.subject
        JOIN (SELECT sort_of, min(w[size(w) - 1]) AS v FROM {both} GROUP BY sort_of) c ON h.sort_of = c.sort_of""",
        h=han,
        both=both,
        listed=listed,
    )
    return sql(
        spark,
        r"""
        SELECT DISTINCT entry, alias, kind, words FROM (
          SELECT entry, replace(array_join(words, ''), '-', '') AS alias, 'full' AS kind, words FROM {t}
          UNION ALL
          SELECT entry, replace(array_join(shorts, ''), '-', ''), 'short', shorts FROM {t}
          UNION ALL
          SELECT entry, entry, 'whole', split(lower(title), ' +') FROM {p} WHERE status = 'ok' AND NOT han
          UNION ALL
          SELECT entry, replace(array_join(ws, ''), '-', ''), 'mixed', ws FROM (
            SELECT entry, explode(flatten(transform(sequence(0, size(words) - 1), i -> array(
              transform(words, (w, j) -> IF(i = j, substr(w, 1, 4), w)),
              transform(words, (w, j) -> IF(i = j, shorts[j], w)))))) AS ws FROM {t})
          UNION ALL
          SELECT entry, array_join(transform(split(array_join(words, '-'), '-'), w -> substr(w, 1, 1)), ''), 'acronym', array(array_join(transform(split(array_join(words, '-'), '-'), w -> substr(w, 1, 1)), '')) FROM {t}
          UNION ALL
          SELECT entry, entry, 'han', IF(c.title IS NULL, array(entry), array(place, subject, sort_of)) FROM {listed} l LEFT JOIN {cut} c ON l.entry = c.title WHERE entry RLIKE r'{HAN}'
          UNION ALL
          SELECT entry, replace(replace(name, ' ', ''), '-', ''), 'full', split(name, ' ') FROM {c}
          UNION ALL
          SELECT entry, replace(array_join(others, ''), '-', ''), IF(size(others) = 1 AND length(others[0]) < 8, 'acronym', 'full'), others FROM {p}
          WHERE status = 'ok' AND other IS NOT NULL AND NOT other RLIKE r'{HAN}')
        WHERE alias <> ''""",
        t=titles,
        c=composed,
        p=parts,
        listed=listed,
        cut=cut,
    )


def _typed(values: DataFrame, cut: DataFrame) -> DataFrame:
    """(raw, typed, words): raw values without decoration, one row for each reading of a value; unspaced ones are cut as the list's titles are."""
    spark = values.sparkSession
    traditional, simplified = simplifying(spark)
    plain = sql(
        spark,
        r"""
        SELECT raw, replace(array_join(words, ''), '-', '') AS typed, array_join(words, '') RLIKE r'{HAN}' AS han, words
        FROM (
          SELECT raw, explode(array(all_words, filter(all_words, w -> w NOT IN ({STOP})))) AS words FROM (
          SELECT raw, filter(split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(part,
              r'^the ', ''),
              r'^(.+), *([^ ,]+ [^ ,]{2,3}|[^ ,]{4,})$', '$2 $1'),
              r'({HAN})[^\p{L}\p{N}]+(?={HAN})', '$1'),
              r'(?<=^| )([a-z])[.](?=[a-z][.])', '$1'), r'[^\p{L}\p{N}_-]+'), w -> w <> '') AS all_words
          FROM (
            SELECT raw, trim(regexp_replace(regexp_replace(regexp_replace(part,
              r'[^\p{L}\p{N})）]+$', ''),
              '(编辑部|编委会|杂志社| *增刊|[,，]? *第 *[0-9]+ *[期卷辑].*)$', ''),
              '([,;.]? *issn[ :]*[0-9x-]+| *[(（][^()（）]*[)）]|[, ]+(vol|no|issue)[. ]*[0-9].*| +[0-9]+ *([(][0-9-]+[)])?([ :,].*)?)$', '')) AS part
            FROM (
              SELECT raw, explode(array_distinct(array(clean, regexp_replace(clean, ' +[:：=/|] .*$', ''), regexp_replace(clean, '^.* [:：=/|] +', '')))) AS part
              FROM (SELECT raw, translate(lower(replace(replace(trim(raw), '&amp;', '&'), '　', ' ')), '{traditional}', '{simplified}') AS clean FROM {v})))))
        WHERE size(words) > 0""",
        v=values,
        traditional=traditional,
        simplified=simplified,
    ).distinct()
    # the longest first part, and the longest last one, that the list's titles have
    return sql(
        spark,
        r"""
        WITH lengths AS (SELECT DISTINCT typed, side, k FROM (SELECT typed, inline(transform(sequence(1, {PART}), k -> struct(k, left(typed, k) AS head, right(typed, k) AS tail))) FROM {p} WHERE han)
                         JOIN (SELECT DISTINCT inline(array(struct('head' AS side, place AS part), struct('tail' AS side, sort_of AS part))) FROM {cut}) ON part = IF(side = 'head', head, tail)),
        found AS (SELECT typed AS key, coalesce(max(IF(side = 'head', k, NULL)), 0) AS a, coalesce(max(IF(side = 'tail', k, NULL)), 0) AS z FROM lengths GROUP BY typed)
        SELECT raw, typed, CASE WHEN NOT han THEN words WHEN key IS NULL OR a + z >= length(typed) THEN array(typed)
                                ELSE filter(array(left(typed, a), substr(typed, a + 1, length(typed) - a - z), right(typed, z)), w -> w <> '') END AS words
        FROM {p} LEFT JOIN found ON typed = key""",
        p=plain,
        cut=cut,
        PART=PART,
    )


def pigeonhole_pairs(aliases: DataFrame, typed: DataFrame) -> DataFrame:
    """(typed, alias, k, d): all pairs within k edits, k set by the length and kind of the alias."""
    spark = aliases.sparkSession
    sized = sql(
        spark,
        r"""
        SELECT alias, n, CASE WHEN acronym THEN 0 WHEN han THEN IF(n >= 5, 1, 0) WHEN n < 8 THEN 0 ELSE least(4, n div 7) END AS k
        FROM (SELECT alias, length(alias) AS n, bool_and(kind = 'acronym') AS acronym, bool_or(kind = 'han') AS han FROM {a} GROUP BY alias)""",
        a=aliases,
    )
    segments = sql(
        spark,
        r"""
        SELECT alias, n, k, i, substring(alias, 1 + (i * n) div (k + 1), ((i + 1) * n) div (k + 1) - (i * n) div (k + 1)) AS seg
        FROM (SELECT alias, n, k, explode(sequence(0, k)) AS i FROM {s})""",
        s=sized,
    )
    # values are few next to their probes, so they are spread before those are made
    spread = typed.select("typed").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the substrings of a typed string that a segment may have become, by the lengths that occur in the list
    probes = sql(
        spark,
        r"""
        SELECT DISTINCT typed, n, k, i, substring(typed, p, ((i + 1) * n) div (k + 1) - (i * n) div (k + 1)) AS seg
        FROM (
          SELECT typed, n, k, i, explode(sequence(greatest(1, 1 + (i * n) div (k + 1) + greatest(-i, m - n - (k - i))),
                                                  1 + (i * n) div (k + 1) + least(i, m - n + (k - i)))) AS p
          FROM (SELECT typed, m, n, k, explode(sequence(0, k)) AS i
                FROM (SELECT typed, m, explode(sequence(m - 4, m + 4)) AS n FROM (SELECT typed, length(typed) AS m FROM {t}))
                JOIN (SELECT DISTINCT n, k FROM {s}) USING (n) WHERE abs(m - n) <= k)
          WHERE greatest(1, 1 + (i * n) div (k + 1) + greatest(-i, m - n - (k - i))) <= 1 + (i * n) div (k + 1) + least(i, m - n + (k - i)))""",
        t=spread,
        s=sized,
    )
    return sql(
        spark,
        r"""
        SELECT typed, alias, k, levenshtein(typed, alias, k) AS d
        FROM (SELECT DISTINCT typed, alias, k FROM {p} JOIN {g} USING (n, k, i, seg))
        WHERE levenshtein(typed, alias, k) >= 0""",
        p=probes,
        g=segments,
    )


def map_to_list(cases: DataFrame, rankings: DataFrame) -> DataFrame:
    """(raw, hint, normalized_name, distance) for the distinct values of ``cases(raw, hint)``.

    ``rankings`` has normalized_name, journal_name, status, source_query. A word of a typed value that
    is itself a word of the list must be a word of the entry: another known word is another title, not
    a misspelling.
    """
    spark = cases.sparkSession
    listed = rankings.where("status = 'ok'").selectExpr("normalized_name AS entry").distinct()
    cut = cut_lineage(title_parts(_han_titles(rankings).select("title")))
    aliases = cut_lineage(_aliases(listed, rankings, cut))
    values = sql(spark, "SELECT raw FROM {c} UNION SELECT hint FROM {c} WHERE hint IS NOT NULL", c=cases)
    typed = cut_lineage(_typed(values, cut))
    # a reading that is an alias as it stands needs no search for near ones, unless the alias is an acronym; other readings of its value do
    exact = sql(spark, "SELECT DISTINCT raw, typed, alias, kind FROM {t} JOIN {a} ON typed = alias", t=typed, a=aliases)
    rest = sql(spark, "SELECT * FROM {t} LEFT ANTI JOIN (SELECT raw, typed FROM {e} WHERE kind <> 'acronym') USING (raw, typed)", t=typed, e=exact)
    pairs = pigeonhole_pairs(aliases, rest).select("typed", "alias", "d").union(sql(spark, "SELECT DISTINCT typed, alias, 0 AS d FROM {e}", e=exact)).distinct()
    found = cut_lineage(
        sql(
            spark,
            r"""
            SELECT t.raw, t.typed, t.words, a.entry, a.kind, p.d, a.words AS alias_words
            FROM {p} p JOIN {t} t ON t.typed = p.typed JOIN {a} a ON a.alias = p.alias""",
            p=pairs,
            t=typed,
            a=aliases,
        )
    )
    # words of the typed value that the list knows but the alias lacks
    strange = sql(
        spark,
        r"""
        SELECT DISTINCT raw, typed, entry, kind, alias_words FROM (
          SELECT raw, typed, entry, kind, alias_words, explode(array_except(words, alias_words)) AS word FROM {f} WHERE d > 0)
        LEFT SEMI JOIN (SELECT DISTINCT explode(words) AS word FROM {a}) USING (word)""",
        f=found,
        a=aliases,
    )
    best = sql(
        spark,
        r"""
        SELECT raw, entry, min(d) AS d, bool_and(kind = 'acronym') AS acronym FROM {f} f
        LEFT ANTI JOIN {s} s ON f.raw = s.raw AND f.typed = s.typed AND f.entry = s.entry AND f.kind = s.kind AND f.alias_words = s.alias_words
        GROUP BY raw, entry""",
        f=found,
        s=strange,
    )
    # a known abbreviation that is itself listed decides among several entries, and whether an acronym stands
    judged = sql(
        spark,
        r"""
        SELECT c.raw, c.hint, b.entry, b.d, b.acronym, (h.entry IS NOT NULL) AS hinted
        FROM {c} c JOIN {b} b ON b.raw = c.raw
        LEFT JOIN {b} h ON h.raw = c.hint AND h.entry = b.entry""",
        c=cases,
        b=best,
    )
    chosen = sql(
        spark,
        r"""
        SELECT raw, hint, min_by(entry, struct(NOT hinted, d, entry)) AS normalized_name, min_by(d, struct(NOT hinted, d, entry)) AS distance
        FROM {j} WHERE NOT (acronym AND hint IS NOT NULL AND NOT hinted) GROUP BY raw, hint""",
        j=judged,
    )
    missed = sql(
        spark,
        "SELECT raw, hint, {u} AS normalized_name, CAST(NULL AS INT) AS distance FROM {c} c LEFT ANTI JOIN {m} m ON c.raw = m.raw AND c.hint <=> m.hint",
        c=cases,
        m=chosen,
        u=f"'{UNMATCHED}'",
    )
    return chosen.unionByName(missed)


def venue_cases(items: DataFrame, rankings: DataFrame) -> DataFrame:
    """(item_key, raw, hint): items whose known venue isn't literally a listed name."""
    spark = items.sparkSession
    venues = items.select(
        "item_key",
        is_known("publication").alias("own"),
        trim_ws("publication").alias("publication"),
        is_known("journal_abbreviation").alias("has_short"),
        trim_ws("journal_abbreviation").alias("short"),
    )
    venues = sql(
        spark,
        r"""
        SELECT DISTINCT item_key, IF(own, publication, short) AS raw, IF(own AND has_short, short, NULL) AS hint
        FROM {v} WHERE own OR has_short""",
        v=venues,
    )
    listed = rankings.where("status = 'ok'").select(rankings.normalized_name.alias("key")).distinct()
    return venues.withColumn("key", journal_key("raw")).join(listed, "key", "left_anti").select("item_key", "raw", "hint")


def map_venues(items: DataFrame, rankings: DataFrame) -> DataFrame:
    """(item_key, raw, normalized_name, distance), one row for every case; ``unmatched`` where nothing fits."""
    cases = cut_lineage(venue_cases(items, rankings))
    mapped = map_to_list(cases.select("raw", "hint").distinct(), rankings)
    return sql(
        cases.sparkSession,
        "SELECT c.item_key, c.raw, m.normalized_name, m.distance FROM {c} c JOIN {m} m ON c.raw = m.raw AND c.hint <=> m.hint",
        c=cases,
        m=mapped,
    )
