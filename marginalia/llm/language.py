"""Languages of texts and of the stretches of mixed texts, by cross-parsing.

For every language a suffix automaton holds a bounded sample of labelled text. A sentence is parsed
greedily into the longest phrases that occur in that sample; the language that needs the fewest phrases
per character wins, and the distance to the second best is the confidence. Neighbouring sentences of
one language form a stretch; sentences with hardly any letters go with the stretch before them.

The automata are dense transition tables, and all sentences of a batch are parsed in step, one
character each at a time, so that the parse is a sequence of array operations.

``SAMPLE_ROWS`` labelled rows per language (those with the least hashes of their keys) and
``SAMPLE_CHARS`` characters of them are used; labels are partly wrong and texts partly mixed, so each
half of the sample is first parsed with the other half and only sentences that clearly agree with their
label stay.

Defined results: an item without abstract and title is no case; empty tables give no rows; a language
without labelled rows is never found; repeated rows count once; texts are processed whole; further
columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions.sql import sql
from marginalia.functions.text import is_known

LANGUAGES = ["en", "zh", "ja", "de", "fr", "es"]
SAMPLE_ROWS = 200
#: A sentence less sure than this opens no stretch of its own.
DOUBT = 0.4
SAMPLE_CHARS = {"en": 24_000, "de": 24_000, "fr": 24_000, "es": 24_000, "zh": 10_000, "ja": 10_000}

#: Names and codes of the languages, in lower case and without region.
NAMES = {
    "en": ["en", "eng", "english", "英文", "英语", "anglais", "englisch", "inglés", "英語"],
    "zh": ["zh", "zho", "chi", "chinese", "中文", "汉语", "简体中文", "繁体中文", "繁體中文", "中文(简体)", "mandarin", "cn"],
    "ja": ["ja", "jpn", "jp", "japanese", "日本語", "日语", "日文"],
    "de": ["de", "deu", "ger", "german", "deutsch", "德语", "德文"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "法语", "法文"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "西班牙语", "西班牙文"],
}

CJK = "぀-ヿ㐀-鿿"
_SPLIT = re.compile(rf"(?<=[。！？])\s*|(?<=[.!?])\s+|(?<=[.!?])(?=[{CJK}])|\s*\n\s*")
_TAGS = re.compile(r"<[^<>]{1,80}>")
_CJK = re.compile(rf"[{CJK}]")
_LETTERS = re.compile(r"[^\W\d_]")


def label_code(label: str) -> str:
    """SQL for the code that a label names: null if unknown, 'other' if it names none of the languages."""
    cases = " ".join(f"WHEN {{0}} IN ({', '.join(repr(n) for n in names)}) THEN '{code}'" for code, names in NAMES.items())
    plain = f"lower(trim({label}))"
    primary = f"regexp_extract({plain}, '^([a-z]{{2,3}})(?:[-_].*)?$', 1)"
    return f"CASE {cases.format(plain)} {cases.format(primary)} ELSE 'other' END"


def clean(text: str) -> str:
    return html.unescape(_TAGS.sub(" ", text))


def sentences(text: str) -> list[tuple[int, str]]:
    """(place, sentence) of a text; places count from the start of the cleaned text."""
    out, at = [], 0
    for m in _SPLIT.finditer(text):
        if m.end() > at and (m.start() > at):
            out.append((at, text[at : m.start()]))
            at = m.end()
        elif m.start() == at:
            at = m.end()
    if at < len(text):
        out.append((at, text[at:]))
    return [(p, s) for p, s in out if s.strip()]


_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_BLANKS = re.compile(r"\s+")


def plain(sentence: str) -> str:
    """What is parsed: lower case, figures and blanks of one kind."""
    return _BLANKS.sub(" ", _DIGITS.sub("0", sentence.lower())).strip()


class Automaton:
    """A suffix automaton with a dense transition table."""

    def __init__(self, text: str):
        links, lengths, edges = [-1], [0], [{}]
        last = 0
        for c in text:
            state = len(links)
            links.append(0)
            lengths.append(lengths[last] + 1)
            edges.append({})
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = state
                p = links[p]
            if p >= 0:
                q = edges[p][c]
                if lengths[p] + 1 == lengths[q]:
                    links[state] = q
                else:
                    copy = len(links)
                    links.append(links[q])
                    lengths.append(lengths[p] + 1)
                    edges.append(dict(edges[q]))
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = links[p]
                    links[q] = links[state] = copy
            last = state
        alphabet = sorted(set(text))
        self.index = np.zeros(0x10000, np.int32)  # 0: a character that the sample lacks
        for k, c in enumerate(alphabet):
            if ord(c) < 0x10000:
                self.index[ord(c)] = k + 1
        number = {c: k + 1 for k, c in enumerate(alphabet)}
        self.width = len(alphabet) + 1
        self.table = np.full(len(links) * self.width, -1, np.int32)
        for state, row in enumerate(edges):
            for c, target in row.items():
                self.table[state * self.width + number[c]] = target

    def phrases(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases needed by each row of ``codes`` (characters as numbers below 65536), rows in falling length."""
        state = np.zeros(len(lengths), np.int32)
        count = np.zeros(len(lengths), np.int32)
        symbols = self.index[codes]
        root = self.table[: self.width]
        active = len(lengths)
        for j in range(codes.shape[1]):
            while active and lengths[active - 1] <= j:
                active -= 1
            if not active:
                break
            symbol = symbols[:active, j]
            now = state[:active]
            target = self.table[now * self.width + symbol]
            miss = target < 0
            # a phrase ends before the character that doesn't go on; one at the root is a phrase of its own
            count[:active] += miss & (now > 0)
            fresh = root[symbol]
            count[:active] += miss & (fresh < 0)
            state[:active] = np.where(miss, np.maximum(fresh, 0), target)
        return count + (state > 0)


class Parser:
    """Automata of all languages."""

    def __init__(self, samples: dict[str, str]):
        self.languages = [x for x in LANGUAGES if samples.get(x)]
        self.automata = [Automaton(samples[x]) for x in self.languages]

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the number of its language (-1: none), the confidence, and whether it has enough letters to tell."""
        n = len(texts)
        best, margin, firm = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
        if not self.languages:
            return best, margin, firm
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        block = 0
        while block < n:
            # a block holds as many rows as keep its matrix small, and always one
            rows = order[block : block + max(1, min(8192, 2_000_000 // max(1, lengths[order[block]])))]
            block += len(rows)
            width = int(lengths[rows[0]])
            if width == 0:
                continue
            joined = np.frombuffer("".join(texts[k].ljust(width) for k in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.minimum(joined, 0xFFFF).astype(np.uint16).reshape(len(rows), width)
            han = ((codes >= 0x3040) & (codes <= 0x9FFF)).sum(axis=1)
            latin = (((codes >= 97) & (codes <= 122)) | ((codes >= 0xDF) & (codes <= 0x24F))).sum(axis=1)
            firm[rows] = 4 * han + latin >= 12
            costs = np.full((len(rows), len(self.languages)), 1 << 30, np.int64)
            for k, (language, automaton) in enumerate(zip(self.languages, self.automata)):
                # a script that makes up less than a quarter of the letters can't be the sentence's own
                own = np.flatnonzero(4 * han >= han + latin) if language in ("zh", "ja") else np.flatnonzero(4 * latin >= han + latin)
                if len(own):
                    costs[own, k] = automaton.phrases(codes[own], lengths[rows][own])
            ranked = np.sort(costs, axis=1)
            best[rows] = np.where(ranked[:, 0] < 1 << 30, costs.argmin(axis=1), -1)
            second = np.minimum(ranked[:, 1], lengths[rows]) if len(self.languages) > 1 else lengths[rows]
            margin[rows] = np.clip(1 - ranked[:, 0] / np.maximum(second, 1), 0, 1)
        return best, margin, firm


def fit(rows: list[tuple[str, str]]) -> dict[str, str]:
    """Cleaned samples by language from (code, text) rows: each half keeps what the other half agrees with."""
    halves: list[dict[str, list[str]]] = [{}, {}]
    turn: dict[str, int] = {}
    for code, text in rows:
        half = turn[code] = 1 - turn.get(code, 1)
        halves[half].setdefault(code, []).extend(plain(s) for _, s in sentences(clean(text)))
    kept: dict[str, list[str]] = {}
    for here, there in ((0, 1), (1, 0)):
        parser = Parser({code: "\n".join(found)[: SAMPLE_CHARS[code]] for code, found in halves[there].items()})
        for code, found in halves[here].items():
            best, margin, firm = parser.judge(found)
            agreed = [s for s, k, sure, ok in zip(found, best, margin, firm) if ok and sure >= DOUBT and parser.languages[k] == code]
            if code not in parser.languages:
                agreed = found
            halves[here][code] = agreed
            kept.setdefault(code, []).extend(agreed)
    return {code: "\n".join(found)[: SAMPLE_CHARS[code]] for code, found in kept.items()}


@functools.lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(samples))


def _segments(samples: dict[str, str]) -> Callable:
    key = tuple(sorted(samples.items()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _parser(key)
        for frame in frames:
            texts, owners, places = [], [], []
            for k, text in enumerate(frame.text):
                for place, sentence in sentences(clean(text)):
                    texts.append(plain(sentence))
                    owners.append(k)
                    places.append(place)
            best, margin, firm = parser.judge(texts)
            out: list[tuple] = []
            owner, language = -1, -1
            for k, place, text, tongue, sure, ok in zip(owners, places, texts, best.tolist(), margin.tolist(), firm.tolist()):
                weight = len(text)
                if k != owner:
                    out.append([k, 1, place, tongue, ok, sure * weight, weight])
                elif not ok or tongue < 0 or tongue == language or (out[-1][4] and sure < DOUBT):
                    out[-1][5] += sure * weight
                    out[-1][6] += weight
                elif not out[-1][4]:
                    # what stands before the first telling sentence goes with it
                    out[-1][3:5] = tongue, True
                else:
                    out.append([k, out[-1][1] + 1, place, tongue, True, sure * weight, weight])
                owner, language = k, out[-1][3]
            parts = pd.DataFrame(out, columns=["k", "seg_no", "start", "tongue", "ok", "sure", "weight"])
            parts = parts[parts.tongue >= 0]
            if parts.empty:
                continue
            yield pd.DataFrame(
                {
                    "item_key": frame.item_key.to_numpy()[parts.k],
                    "label": frame.label.to_numpy()[parts.k],
                    "seg_no": parts.seg_no.astype(np.int32),
                    "start": parts.start.astype(np.int32),
                    "language": np.array(parser.languages, dtype=object)[parts.tongue.to_numpy(int)],
                    "confidence": parts.sure / parts.weight.clip(lower=1),
                    "n_segments": parts.groupby("k").seg_no.transform("max").astype(np.int32),
                }
            )

    return run


def labelled_texts(items: DataFrame) -> DataFrame:
    """(item_key, label, title, text): abstract, else title; label is a code, 'other', or null if unknown."""
    shown = items.select(
        "item_key",
        "title",
        F.when(is_known("language"), F.col("language")).alias("language"),
        F.when(is_known("abstract_note"), F.col("abstract_note")).when(is_known("title"), F.col("title")).alias("text"),
    )
    return shown.where("text IS NOT NULL").selectExpr("item_key", f"IF(language IS NULL, NULL, {label_code('language')}) AS label", "title", "text")


def language_sample(texts: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """The cleaned samples, from at most ``rows`` labelled rows of each language."""
    chosen = sql(
        texts.sparkSession,
        """
        SELECT label, item_key FROM (
          SELECT label, item_key, row_number() OVER (PARTITION BY label ORDER BY xxhash64(item_key), item_key) AS place FROM {texts} WHERE label <> 'other')
        WHERE place <= {rows}""",
        texts=texts,
        rows=rows,
    )
    drawn = texts.join(F.broadcast(chosen), ["label", "item_key"], "left_semi").select("label", "item_key", F.concat_ws("\n", "title", "text").alias("text")).distinct().collect()
    drawn.sort(key=lambda r: (r.label, r.item_key, r.text))
    return fit([(r.label, r.text) for r in drawn])


def language_segments(items: DataFrame) -> DataFrame:
    """(item_key, seg_no, start, language, confidence, n_segments, label) of every stretch of every item."""
    texts = labelled_texts(items)
    samples = language_sample(texts)
    schema = "item_key string, label string, seg_no int, start int, language string, confidence double, n_segments int"
    return texts.drop("title").mapInPandas(_segments(samples), schema)


def language_cases(items: DataFrame) -> DataFrame:
    """Stretches of items whose label is unknown or wrong, or whose text mixes languages."""
    found = language_segments(items)
    return found.where("label IS NULL OR n_segments > 1 OR label <> language").dropDuplicates(["item_key", "seg_no", "language"])
