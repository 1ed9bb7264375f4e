"""Spellings of organisations and people that mean the same entity.

Every spelling is parsed into a *stem* (the distinctive token: family name, or proper name of an
organisation) and other fields (type of organisation, given name, initials). Stems are compared by
suffix blocking: suffixes of a stem (and, as the tail may be what is misspelt, of the stem read
backwards) of at least about half its length are indexed. A suffix held by more than ``common`` stems is
refined with other fields: first with each pair of neighbours among the opening four letters, then, where
that is still common, with each three neighbours among the opening six; an edit in the opening leaves one
of them whole. What is common even then stays, as dropping it would lose links. Pairs are compared by the
ratio of their longest common subsequence; lengths are only bounded by what the ratio allows.

Organisations link when stems agree and types are equal; a raw address of a card links the card's
spelling to the spelling in the address, which joins names in different scripts. A name without any word
of a type has all words of its first part as its stem. People link when family names agree and given
names are equal, nicknames of each other, or near by the same blocking; initials link where exactly one
person of that family fits. Names in Han script link when they are equal without blanks and signs, in
simplified characters, in either order of the fields. Links are closed by connected components.

Defined results: unknown values are no spelling; empty tables give no rows; repeated rows count once;
spellings are kept as written; kinds are never mixed; further columns are ignored; lists of people that
can't be read hold nobody.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from marginalia.functions.sql import sql as named_sql
from marginalia.functions.text import is_known
from marginalia.llm.scripts import simplifying
from marginalia.operators.graph import components
from marginalia.session import cut_lineage

#: Accented letters and their bases, place by place.
ACCENTED = "áàâäãåāçčéèêëēėęíìîïīñńóòôöõøōšśúùûüūýÿžźż"
BASE = "aaaaaaacceeeeeeeiiiiinnooooooossuuuuuyyzzz"

#: Full given names and the short forms in general use for them; a parameter of ``people_variants``.
SHORT_FORMS = {
    "alexander": "alex sasha sandy al xander", "alfred": "alf fred", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "camille": "cam milly",
    "charles": "charlie chuck", "christopher": "chris kit", "dagmar": "dag", "daniel": "dan danny", "david": "dave", "dorothy": "dot dolly", "edward": "ed ted eddie ned",
    "elizabeth": "liz beth betty eliza lisa lizzie libby", "francis": "frank", "frederick": "freddy", "gabriel": "gabe", "george": "georgie", "gerald": "gerry jerry", "gustavo": "gus tavo",
    "helen": "nell nellie", "henry": "harry hank", "ingeborg": "inge", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hans", "jonathan": "jon jonny nathan john",
    "joseph": "joe joey", "josephine": "josie", "katherine": "kate kathy katie kat kitty", "kenneth": "ken", "lawrence": "laurie", "leonard": "leo len", "lorenzo": "larry enzo renzo",
    "margaret": "maggie peggy meg greta marge rita", "matthew": "matt", "maximilian": "max", "michael": "mike mick mickey", "nicholas": "nicky", "nikolas": "nik nick niko klaus",
    "osvaldo": "ozzy valdo", "patricia": "pat trish patty tricia", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "dick rick richie", "robert": "bob rob bobby bert robbie",
    "ronald": "ron", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie suzy", "theodora": "thea dora theo", "thomas": "tom tommy", "timothy": "tim", "ulrike": "uli ulli rike",
    "victoria": "vicky vic tori", "vincent": "vince", "walter": "walt", "wilhelmina": "mina minna", "william": "will bill willy billy liam",
}
NICKNAMES = {short: full for full, shorts in SHORT_FORMS.items() for short in shorts.split()}

#: Words of an organisation's type, with their short forms.
TYPE_WORDS = {
    "university": ["univ", "uni"], "polytechnic": ["polytech", "poly"], "institute": ["inst"], "building": ["bldg", "build"],
    "research": ["res"], "technology": ["tech", "technol"], "normal": ["norm"], "academy": ["acad"], "college": ["coll"],
    "hospital": ["hosp"], "laboratory": ["lab", "labs", "laboratories"], "centre": ["center", "ctr", "centr"], "school": ["sch"], "company": ["co", "corp", "corporation"],
    "agency": [], "council": [], "ministry": ["min"], "museum": ["mus"], "observatory": ["obs"],
}

#: Words that name an organisation, and words that name one if none of the former stands beside them.
HEADS = ("university", "polytechnic", "institute", "academy", "college")
MINOR_HEADS = ("hospital", "laboratory", "centre", "school", "company", "agency", "council", "ministry", "museum", "observatory")


#: Words that tell no organisation from another.
SMALL_WORDS = ("of", "the", "and", "for", "at", "in", "de", "del", "la", "le", "les", "di", "du", "des", "der", "die", "das", "fur", "und", "et", "y", "e")


def _literal(values: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in values.items()) + ")"


CONSTANTS = {
    "ACCENTED": ACCENTED,
    "BASE": BASE,
    "HAN": r"\p{IsHan}",
    "SHORT": _literal({short: word for word, shorts in TYPE_WORDS.items() for short in shorts}),
    "WORDS": "array(" + ", ".join(f"'{w}'" for w in TYPE_WORDS) + ")",
    "HEADS": "array(" + ", ".join(f"'{w}'" for w in HEADS) + ")",
    "SMALL": ", ".join(f"'{w}'" for w in SMALL_WORDS),
    "MINOR": "array(" + ", ".join(f"'{w}'" for w in MINOR_HEADS) + ")",
}


def sql(spark: SparkSession, text: str, **names) -> DataFrame:
    return named_sql(spark, text, **CONSTANTS, **names)


def lcs_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    """Lengths of longest common subsequences, bit-parallel over all pairs at once (64 characters; longer ones one by one)."""

    def codes(x: pd.Series, width: int) -> np.ndarray:
        out = np.zeros((len(x), width), np.uint32)
        for k, s in enumerate(x):
            out[k, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        return out

    result = np.zeros(len(a), np.int32)
    size_a, size_b = a.str.len().to_numpy(), b.str.len().to_numpy()
    short = np.flatnonzero((size_a <= 64) & (size_b <= 64))
    if len(short):
        x, y = codes(a.iloc[short], int(size_a[short].max())), codes(b.iloc[short], int(size_b[short].max()))
        powers = np.left_shift(np.uint64(1), np.arange(x.shape[1], dtype=np.uint64))
        state = np.full(len(short), ~np.uint64(0), np.uint64)
        for j in range(y.shape[1]):
            column = y[:, j : j + 1]
            match = (((x == column) & (column > 0)) * powers).sum(axis=1, dtype=np.uint64)
            both = state & match
            state = (state + both) | (state - both)
        mask = np.where(size_a[short] == 64, ~np.uint64(0), np.left_shift(np.uint64(1), size_a[short].astype(np.uint64) % np.uint64(64)) - np.uint64(1))
        result[short] = np.bitwise_count(~state & mask)
    for k in np.flatnonzero((size_a > 64) | (size_b > 64)):
        row = np.zeros(size_b[k] + 1, np.int32)
        other = np.frombuffer(b.iloc[k].encode("utf-32-le", "surrogatepass"), np.uint32)
        for c in a.iloc[k]:
            new = np.maximum(row[1:], row[:-1] + (other == ord(c)))
            row[1:] = np.maximum.accumulate(new)
        result[k] = row[-1]
    return pd.Series(result)


@F.pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return 2.0 * lcs_lengths(a, b) / (a.str.len() + b.str.len())


def _refined(index: DataFrame, common: int, size: int, within: int) -> DataFrame:
    """``index(stem, field, side, whole, suffix, block)``: rows in blocks of more than ``common`` stems get finer blocks.

    A finer block is the suffix with ``size`` neighbouring letters out of the first ``within`` of the stem. Blocks of one stem are dropped.
    """
    return sql(
        index.sparkSession,
        """
        SELECT stem, field, side, whole, suffix, explode(IF(n > {common},
                 array_distinct(transform(sequence(1, greatest(1, least(length(whole), {within}) - {size} + 1)), i -> concat(suffix, '|', substr(whole, i, {size})))), array(block))) AS block
        FROM {index} i
        JOIN (SELECT field AS f, side AS s, block AS x, count(*) AS n FROM {index} GROUP BY field, side, block HAVING count(*) > 1) ON field = f AND side = s AND block = x""",
        index=index,
        common=common,
        size=size,
        within=within,
    )


def near_stems(stems: DataFrame, least: float = 0.86, common: int = 200, shortest: int = 4) -> DataFrame:
    """(field, a, b): pairs of distinct ``stems(stem, field)`` of the same field whose LCS ratio is at least ``least``."""
    spark = stems.sparkSession
    index = sql(
        spark,
        """
        SELECT stem, field, side, whole, suffix, suffix AS block
        FROM (SELECT stem, field, side, whole, explode(transform(sequence(greatest({shortest}, length(whole) div 2 - 1), length(whole)), n -> right(whole, n))) AS suffix
              FROM (SELECT stem, field, inline(array(struct('tail' AS side, stem AS whole), struct('head' AS side, reverse(stem) AS whole))) FROM {stems})
              WHERE length(whole) >= {shortest})""",
        stems=stems,
        shortest=shortest,
    )
    blocks = _refined(_refined(index, common, 2, 4), common, 3, 6)
    # an LCS is no longer than the shorter stem, which bounds the lengths
    pairs = sql(
        spark,
        """
        SELECT DISTINCT p.field, p.stem AS a, q.stem AS b FROM {blocks} p JOIN {blocks} q ON p.field = q.field AND p.side = q.side AND p.block = q.block AND p.stem < q.stem
        WHERE 2 * least(length(p.stem), length(q.stem)) >= {least} * (length(p.stem) + length(q.stem))""",
        blocks=blocks,
        least=least,
    )
    return pairs.where(lcs_ratio("a", "b") >= least)


def _all_pairs(kind: str, members: DataFrame) -> DataFrame:
    return sql(
        members.sparkSession,
        "SELECT DISTINCT '{kind}' AS kind, a.spelling AS name_a, b.spelling AS name_b FROM {members} a JOIN {members} b ON a.entity = b.entity AND a.spelling < b.spelling",
        kind=kind,
        members=members,
    )


def parse_organisations(names: DataFrame) -> DataFrame:
    """(name, core, stem, field) for ``names(name)``; a name in two scripts has a row for each."""
    spark = names.sparkSession
    latin = sql(
        spark,
        r"""
        WITH parts AS (
          SELECT name, place, filter(split(part, r'[^\p{L}\p{N}-]+'), w -> w <> '') AS words FROM (
            SELECT name, posexplode(split(translate(lower(regexp_replace(name, r'{HAN}+', ' ')), '{ACCENTED}', '{BASE}'), r'[,;()（），；]|\s-\s')) AS (place, part)
            FROM {names})),
        typed AS (
          SELECT name, place, transform(words, w -> struct(w AS word, coalesce({SHORT}[w],
            try_element_at(filter({WORDS}, t -> w = t OR (length(w) >= 5 AND levenshtein(w, t, 2) >= 0)), 1)) AS sort_of)) AS tokens FROM parts),
        held AS (
          SELECT name, place, exists(tokens, t -> array_contains({HEADS}, t.sort_of)) AS head, exists(tokens, t -> array_contains({MINOR}, t.sort_of)) AS minor,
                 transform(filter(tokens, t -> t.sort_of IS NULL AND t.word NOT IN ({SMALL})), t -> t.word) AS own,
                 array_join(array_sort(array_distinct(transform(filter(tokens, t -> t.sort_of IS NOT NULL), t -> t.sort_of))), ' ') AS field
          FROM typed),
        -- words of four letters tell organisations apart; where there are none, shorter ones must
        stemmed AS (
          SELECT name, place, head, minor, IF(head OR minor, field, '') AS field,
                 array_join(IF(exists(own, w -> length(w) >= 4), filter(own, w -> length(w) >= 4), own), ' ') AS stem FROM held)
        -- the last part with a word of an organisation; else the last with a minor one; else the first part
        SELECT name, concat(field, '|', stem) AS core, stem, field FROM (
          SELECT name, max_by(stem, struct(head, minor, IF(head OR minor, place, -place))) AS stem, max_by(field, struct(head, minor, IF(head OR minor, place, -place))) AS field
          FROM stemmed WHERE stem <> '' GROUP BY name)""",
        names=names,
    )
    han = sql(
        spark,
        r"""
        SELECT name, core, CAST(NULL AS STRING) AS stem, CAST(NULL AS STRING) AS field FROM (
          SELECT name, regexp_extract(name, r'({HAN}+?(?:大学|研究院|研究所|科学院|学院|学校|医院|实验室|公司))', 1) AS core FROM {names}) WHERE core <> ''""",
        names=names,
    )
    return latin.unionByName(han)


def organisation_classes(cards: DataFrame) -> DataFrame:
    """(spelling, entity) for the first-author affiliations of ``cards``: one row for each spelling."""
    spark = cards.sparkSession
    shown = cards.select(
        F.when(is_known("first_author_affiliation"), F.col("first_author_affiliation")).alias("own"),
        F.when(is_known("first_author_affiliation_raw"), F.col("first_author_affiliation_raw")).alias("raw"),
    )
    shown = cut_lineage(
        sql(
            spark,
            r"""
            SELECT DISTINCT coalesce(own, raw) AS spelling,
                   split(regexp_replace(IF(own IS NULL, NULL, raw), r'^[\s"]+', ''), r'"|;|；|\n|\s[|/]\s|(?<=\S)\s+[a-z]\s+(?=\p{Lu})|(?<=\S)\s*[²³]|(?<=\S)\s+\(2\)')[0] AS address
            FROM {shown} WHERE own IS NOT NULL OR raw IS NOT NULL""",
            shown=shown,
        )
    )
    names = sql(spark, "SELECT spelling AS name FROM {shown} UNION SELECT address FROM {shown} WHERE address IS NOT NULL", shown=shown)
    parsed = cut_lineage(parse_organisations(names))
    near = near_stems(sql(spark, "SELECT DISTINCT stem, field FROM {parsed} WHERE stem IS NOT NULL", parsed=parsed))
    edges = sql(
        spark,
        """
        SELECT concat(field, '|', a) AS a, concat(field, '|', b) AS b FROM {near}
        UNION ALL
        SELECT a.core, b.core FROM {parsed} a JOIN {parsed} b ON a.name = b.name
        UNION ALL
        SELECT o.core, r.core FROM {shown} s JOIN {parsed} o ON s.spelling = o.name JOIN {parsed} r ON s.address = r.name
        WHERE o.stem IS NULL OR r.stem IS NULL OR (o.field = r.field AND levenshtein(o.stem, r.stem, 3) >= 0)""",
        near=near,
        parsed=parsed,
        shown=shown,
    )
    roots = components(edges)
    # a name in two scripts has two cores, which are linked; one of them stands for it
    return sql(
        spark,
        """
        SELECT s.spelling, min(coalesce(c.root, p.core, s.spelling)) AS entity
        FROM (SELECT DISTINCT spelling FROM {shown}) s LEFT JOIN {parsed} p ON s.spelling = p.name LEFT JOIN {roots} c ON p.core = c.node GROUP BY s.spelling""",
        shown=shown,
        parsed=parsed,
        roots=roots,
    )


def creator_spellings(items: DataFrame) -> DataFrame:
    """(spelling, first, last): every way a creator is written, with the fields it was put together from."""
    listed = F.from_json("creators_json", "array<struct<name:string, firstName:string, lastName:string>>")
    people = items.select("creators_json").distinct().select(F.explode(listed).alias("p"))
    whole = F.trim("p.name")
    joined = F.trim(F.concat_ws(" ", F.coalesce("p.firstName", F.lit("")), F.coalesce("p.lastName", F.lit(""))))
    return (
        people.select(
            F.when(whole != "", whole).otherwise(joined).alias("spelling"),
            F.when(whole != "", None).otherwise(F.col("p.firstName")).alias("first"),
            F.when(whole != "", None).otherwise(F.col("p.lastName")).alias("last"),
        )
        .where("spelling <> ''")
        .distinct()
    )


def parse_people(names: DataFrame) -> DataFrame:
    """(spelling, family, given, initials) of names without Han characters; ``names`` has spelling and, where known, first and last.

    The family name stands before a comma, or is in capitals. Elsewhere it is the token with the greater
    share of uses as a family name where that is told (by the field, before a comma, in capitals, alone
    with initials), then with the greater share of last places, then the longest. Tokens never seen count
    as even. These are shares of each token's own uses, so how many people bear a name makes no difference,
    and a few rows with their fields exchanged do no harm.
    """
    spark = names.sparkSession
    told = (
        names
        if {"first", "last"} <= set(names.columns)
        else names.select("spelling", F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"))
    )
    return sql(
        spark,
        r"""
        WITH words AS (
          SELECT spelling, contains(spelling, ',') AS comma, size(filter(split(substring_index(spelling, ',', 1), r'[^\p{L}\p{M}''’-]+'), w -> w <> '')) AS before,
                 filter(split(spelling, r'[^\p{L}\p{M}''’-]+'), w -> w <> '') AS raw FROM (SELECT DISTINCT spelling FROM {told}) WHERE NOT spelling RLIKE r'{HAN}'),
        tokens AS (
          SELECT spelling, comma, before, place, word, regexp_replace(translate(lower(word), '{ACCENTED}', '{BASE}'), r'[^\p{L}]', '') AS token,
                 word = upper(word) AND length(word) > 3 AS capital, length(word) = 1 OR (length(word) <= 3 AND word = upper(word)) AS initial
          FROM (SELECT spelling, comma, before, posexplode(raw) AS (place, word) FROM words)),
        written AS (
          SELECT spelling, count_if(NOT initial) AS n_words, count_if(initial) AS n_initials, count_if(capital) AS n_capitals, max(IF(initial, NULL, place)) AS last FROM tokens GROUP BY spelling),
        fields AS (
          SELECT regexp_replace(translate(lower(word), '{ACCENTED}', '{BASE}'), r'[^\p{L}]', '') AS token, sure
          FROM (SELECT sure, explode(split(field, r'[^\p{L}\p{M}''’-]+')) AS word
                FROM (SELECT inline(array(struct(last AS field, true AS sure), struct(first AS field, false AS sure))) FROM {told} WHERE trim(first) <> '' AND trim(last) <> ''))
          WHERE length(word) > 1),
        uses AS (
          SELECT token, CASE WHEN comma THEN CASE WHEN place = 0 THEN true WHEN place >= before THEN false END
                             WHEN n_capitals BETWEEN 1 AND n_words - 1 THEN capital
                             WHEN n_words = 1 AND n_initials > 0 THEN true END AS sure,
                 NOT comma AND n_capitals IN (0, n_words) AND n_words > 1 AS plain, place = last AS at_end
          FROM tokens JOIN written USING (spelling) WHERE NOT initial
          UNION ALL
          SELECT token, sure, false, false FROM fields),
        shares AS (
          SELECT token, (count_if(sure) + 1) / (count(sure) + 2) AS family_share, (count_if(plain AND at_end) + 1) / (count_if(plain) + 2) AS end_share FROM uses GROUP BY token),
        chosen AS (
          SELECT spelling, max_by(t.token, struct(comma AND place = 0, capital, family_share, end_share, length(t.token), -place)) AS family
          FROM tokens t JOIN shares s ON t.token = s.token WHERE NOT initial GROUP BY spelling)
        SELECT c.spelling, c.family, min_by(IF(t.initial OR t.token = c.family, NULL, t.token), t.place) AS given,
               upper(coalesce(array_join(transform(array_sort(collect_list(IF(t.token = c.family, NULL, struct(t.place, IF(t.initial, t.word, left(t.word, 1)) AS letters)))), x -> x.letters), ''), '')) AS initials
        FROM chosen c JOIN tokens t ON c.spelling = t.spelling GROUP BY c.spelling, c.family""".replace("''’", r"\x27’"),
        told=told,
    )


def han_people(names: DataFrame) -> DataFrame:
    """(spelling, entity) of names with Han characters: its Han characters, simplified, the family field first where fields are known."""
    traditional, simplified = simplifying(names.sparkSession)
    return sql(
        names.sparkSession,
        r"""
        SELECT spelling, concat('han|', min(whole)) AS entity FROM (
          SELECT spelling, regexp_replace(translate(IF(last RLIKE r'{HAN}' AND first RLIKE r'{HAN}', concat(last, first), spelling), '{traditional}', '{simplified}'), r'[^\p{IsHan}]+', '') AS whole
          FROM {names} WHERE spelling RLIKE r'{HAN}')
        GROUP BY spelling""",
        names=names,
        traditional=traditional,
        simplified=simplified,
    )


def people_classes(items: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(spelling, entity) for the creators of ``items``: one row for each spelling."""
    spark = items.sparkSession
    written = cut_lineage(creator_spellings(items))
    people = cut_lineage(parse_people(written))
    near = near_stems(sql(spark, "SELECT DISTINCT family AS stem, '' AS field FROM {people}", people=people))
    families = components(near)
    placed = cut_lineage(
        sql(
            spark,
            """
            SELECT spelling, coalesce(root, family) AS family, coalesce({NICK}[given], given) AS given, initials
            FROM {people} LEFT JOIN {families} ON family = node""",
            people=people,
            families=families,
            NICK=_literal(NICKNAMES if nicknames is None else nicknames),
        )
    )
    # given names of one family that are near each other
    givens = sql(spark, "SELECT DISTINCT family AS field, given AS stem FROM {placed} WHERE given IS NOT NULL", placed=placed)
    alike = near_stems(givens, least=0.8, shortest=2)
    roots = components(sql(spark, "SELECT concat(field, '|', a) AS a, concat(field, '|', b) AS b FROM {alike}", alike=alike))
    named = cut_lineage(
        sql(
            spark,
            """
            SELECT spelling, family, given, initials, coalesce(root, concat(family, '|', given)) AS entity
            FROM {placed} LEFT JOIN {roots} ON concat(family, '|', given) = node WHERE given IS NOT NULL""",
            placed=placed,
            roots=roots,
        )
    )
    # initials stand for the one person of the family they fit; a second initial counts where the person has one
    fits = sql(
        spark,
        """
        WITH persons AS (
          SELECT family, entity, array_distinct(flatten(collect_set(array(left(given, 1), left(lower(initials), 1))))) AS firsts,
                 collect_set(IF(length(initials) > 1, substr(initials, 2, 1), NULL)) AS seconds
          FROM {named} GROUP BY family, entity)
        SELECT s.spelling, p.entity, array_contains(p.seconds, substr(s.initials, 2, 1)) AS sure
        FROM (SELECT spelling, family, initials FROM {placed} WHERE given IS NULL AND initials <> '') s
        JOIN persons p ON s.family = p.family AND array_contains(p.firsts, lower(left(s.initials, 1)))""",
        named=named,
        placed=placed,
    )
    return sql(
        spark,
        """
        SELECT spelling, entity FROM {named}
        UNION ALL
        SELECT spelling, coalesce(IF(count_if(sure) = 1, max(IF(sure, entity, NULL)), NULL), max(entity)) FROM {fits}
        GROUP BY spelling HAVING count_if(sure) = 1 OR count(*) = 1
        UNION ALL
        SELECT spelling, concat(family, '|', initials) FROM {placed} p LEFT ANTI JOIN {fits} f ON p.spelling = f.spelling WHERE given IS NULL
        UNION ALL
        SELECT spelling, entity FROM {han}""",
        named=named,
        fits=fits,
        placed=placed,
        han=han_people(written),
    )


def organisation_variants(cards: DataFrame) -> DataFrame:
    """(kind, name_a, name_b) for the first-author affiliations of ``cards``."""
    return _all_pairs("affiliation", organisation_classes(cards))


def people_variants(items: DataFrame) -> DataFrame:
    """(kind, name_a, name_b) for the creators of ``items``."""
    return _all_pairs("creator", people_classes(items))


def name_variants(cards: DataFrame, items: DataFrame) -> DataFrame:
    """Every pair of spellings of one entity; ``name_classes`` says the same in one row for each spelling."""
    return organisation_variants(cards).unionByName(people_variants(items))


def name_classes(cards: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, spelling, entity, n_spellings): every spelling with its class; entity is the least spelling of the class."""
    members = organisation_classes(cards).selectExpr("'affiliation' AS kind", "spelling", "entity").unionByName(people_classes(items).selectExpr("'creator' AS kind", "spelling", "entity"))
    classes = members.groupBy("kind", "entity").agg(F.min("spelling").alias("_least"), F.count("*").alias("n_spellings"))
    return members.join(classes, ["kind", "entity"]).select("kind", "spelling", F.col("_least").alias("entity"), "n_spellings")
