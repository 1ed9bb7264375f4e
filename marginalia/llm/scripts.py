"""Han characters in simplified form, by the public rules that Spark's own Unicode library brings along."""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession


@functools.cache
def _table(spark: SparkSession) -> tuple[str, str]:
    every = "".join(map(chr, [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000), *range(0xF900, 0xFB00)]))
    simple = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate(every)
    if len(simple) != len(every):
        raise RuntimeError("characters and their simplified forms don't go one to one")
    pairs = [(a, b) for a, b in zip(every, simple) if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def simplifying(spark: SparkSession) -> tuple[str, str]:
    """Traditional characters and their simplified forms, place by place, for ``translate``; about 3,000."""
    return _table(spark)
