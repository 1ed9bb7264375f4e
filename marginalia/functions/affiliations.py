"""The first affiliation on a title page, by a table of rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from marginalia.functions.scalars import text_of
from marginalia.functions.text import ColumnOrName, let, trim_ws


@dataclass(frozen=True)
class Rules:
    """What tells an affiliation from other lines. Latin words count as whole words, case ignored; Han words anywhere."""

    #: Words of lines that hold an affiliation.
    places: tuple[str, ...] = (
        "university", "universität", "universidad", "université", "polytechnic", "institute", "institut", "academy", "college", "school", "faculty", "department",
        "laboratory", "hospital", "centre", "center", "company", "corporation", "大学", "学院", "研究所", "研究院", "科学院", "实验室", "医院", "公司",
    )
    #: Words of lines that hold something else.
    others: tuple[str, ...] = ("abstract", "summary", "keywords", "key words", "doi", "received", "accepted", "published", "email", "e-mail", "phone", "copyright", "摘要", "关键词", "收稿日期", "通信作者", "作者简介")
    #: Lines that are looked at, lines that may go on with the first one, and characters kept.
    lines: int = 120
    follow: int = 2
    longest: int = 300
    #: A line that goes on has a word of ``places`` or a number like this.
    postcode: str = r"\b\d{4,6}\b"
    #: Signs, or one letter or figure, in front of an address; and where the next address begins in a line.
    label: str = r"^[^\p{L}\p{Nd}]*(?:[a-z0-9][ ,)]+(?=\p{Lu}|\p{IsHan}))?"
    next_label: str = r"[ ,;]+[b-z][ )](?=\p{Lu}).*$"

    def pattern(self, words: tuple[str, ...]) -> str:
        latin, han = [w for w in words if w.isascii() or w[0] < "ɐ"], [w for w in words if w[0] >= "ɐ"]
        whole = [rf"(?<!\p{{L}})(?:{'|'.join(latin)})(?!\p{{L}})"] if latin else []
        return "(?iu)" + "|".join(whole + han or ["(?!)"])


def affiliation_of(x: ColumnOrName, rules: Rules = Rules()) -> Column:
    """The first line with a word of a place, and the next lines as long as they go on; empty if there is none.

    Expressed over the array of non-blank lines: the place of the first such line is looked up, the lines
    behind it are cut at the first one that is something else, and those that go on are joined to it.
    """
    place, other = rules.pattern(rules.places), rules.pattern(rules.others)
    lines = F.slice(F.filter(F.transform(F.split(text_of(x), r"\r\n|\n|\r"), lambda v: F.regexp_replace(trim_ws(v), r"(?U)\s+", " ")), lambda v: v != ""), 1, rules.lines)

    def addresses(kept: Column, at: Column) -> Column:
        behind = F.slice(kept, at + 1, rules.follow)
        before_stop = let(
            F.array_position(F.transform(behind, lambda v: v.rlike(other)), True).cast("int"), lambda stop: F.when(stop > 0, F.slice(behind, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(behind)
        )
        going_on = F.filter(before_stop, lambda v: v.rlike(place) | v.rlike(rules.postcode))
        clean = F.transform(F.concat(F.slice(kept, at, 1), going_on), lambda v: F.regexp_replace(F.regexp_replace(v, rules.label, ""), r"[ ,;]+$", ""))
        return F.substring(F.regexp_replace(F.array_join(clean, ", "), rules.next_label, ""), 1, rules.longest)

    return let(
        lines, lambda kept: let(F.array_position(F.transform(kept, lambda v: v.rlike(place) & ~v.rlike(other)), True).cast("int"), lambda at: F.when(at > 0, addresses(kept, at)).otherwise(""))
    )
