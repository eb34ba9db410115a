"""Quality rules with distribution divergence.

Base rules count words, symbols, repeated lines and repeated word windows in the
whole text. Then the text's histograms of character classes and of its
language's commonest words are compared with references, which are gathered from
all documents of that language, by Jensen-Shannon distance (base 2, so 0 to 1).
Texts under ``MIN_WORDS`` are not compared: their histograms are too coarse. Nor
are texts whose language has too few words for a reference, for lack of other
texts than the compared one: such pass on the base rules alone.

The references are counted in one pass with bounded partial counts, summed by
key, and cut to the top words per language by a group limit; only languages
of ``LEAST_REFERENCE`` words, times (words + classes), reach the driver.

Defined results: a null or blank text has no words and fails the base rules; a
null language is a language of its own; repeated rows are judged alike; an empty
table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import small_batches, staged

#: Base rules, as contracted.
BASE_WORDS, BASE_REPEAT = 50, 50
#: Divergence: words under which no verdict is given, and the distances that reject. A histogram of n
#: words strays from its source by about 1 / sqrt(n), so the words' limit is 0.25 + 2 / sqrt(n).
MIN_WORDS = 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, WORD_SPREAD = 0.35, 0.25, 2.0
TOP_WORDS = 48
_FLUSH = 100_000
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words that a reference must have, at least and for each word of the text that is compared with it.
LEAST_REFERENCE, REFERENCE_TIMES = 5_000, 10


def _class_of(byte: int) -> int:
    """The class of the character that starts with this UTF-8 byte: one of seven in ASCII, beyond it by range of code points; -1 within a character."""
    if byte < 128:
        return 0 if 97 <= byte <= 122 else 1 if 65 <= byte <= 90 else 2 if 48 <= byte <= 57 else 3 if byte in _BLANKS else 4 if byte in b".,;:!?'\"()-" else 6 if byte < 32 or byte == 127 else 5
    # up to U+02BF (Latin), U+052F (Greek, Cyrillic), U+07FF (Hebrew, Arabic), U+1FFF, U+2FFF (signs), U+3FFF (kana), U+9FFF (ideographs), U+DFFF (Hangul), U+FFFF, beyond
    last = (0xCA, 0xD4, 0xDF, 0xE1, 0xE2, 0xE3, 0xE9, 0xED, 0xEF, 0xFF)
    return -1 if byte < 0xC0 else 7 + next(i for i, end in enumerate(last) if byte <= end)


_CLASS = np.array([_class_of(c) for c in range(256)])
N_CLASSES = 17
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at exactly these six blanks
    n = len(words)
    chars = len(text) - sum(data.count(_BLANKS[i : i + 1]) for i in range(6))
    symbols = sum(data.count(_SYMBOLS[i : i + 1]) for i in range(8))
    lines = [x for x in data.split(b"\n") if x.split()] if b"\n" in data else []
    repeat = 0
    if n >= 4:
        seen: dict = {}
        at = np.fromiter((seen.setdefault(t, len(seen)) for t in zip(words, words[1:], words[2:], strict=False)), dtype=np.int64, count=n - 2)
        if len(seen) < n - 2:
            twice = np.bincount(at)[at] > 1
            cover = np.zeros(n, dtype=bool)
            for i in range(3):
                cover[i : n - 2 + i] |= twice
            repeat = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def class_counts(data: bytes) -> np.ndarray:
    """Characters by class."""
    starts = _CLASS >= 0
    return np.bincount(_CLASS[starts], weights=np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)[starts], minlength=N_CLASSES)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; an empty histogram is at distance 1."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(kl) / 2)))


def _word_counts(words: list[bytes]) -> Counter:
    return Counter(w.strip(b".,;:!?'\"()-") for w in words)


def references(docs: DataFrame, lang: str = "lang", text: str = "text", top_words: int = TOP_WORDS) -> dict[str | None, tuple[list[str], np.ndarray, np.ndarray]]:
    """By language: its top words, their counts with the rest's last, and its character-class counts, from all rows."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def flush() -> pd.DataFrame:
            rows = [(k[0], k[1], k[2], n) for k, n in found.items()]
            found.clear()
            return pd.DataFrame(rows, columns=["lang", "kind", "key", "n"])

        for batch in batches:
            for own, value in zip(batch["lang"], batch["text"], strict=True):
                own = None if own is None or own != own else own
                data = (value or "").encode()
                for word, n in _word_counts(data.translate(_LOWER).split()).items():
                    found[own, 0, word.decode()] += n
                for c, n in enumerate(class_counts(data)):
                    found[own, 1, str(c)] += int(n)
                if len(found) >= _FLUSH:
                    yield flush()
        yield flush()

    parts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInPandas(count, "lang string, kind int, key string, n long")
    summed = staged(parts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "references")
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    top = summed.where("key <> '' or kind = 1").withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(top_words, N_CLASSES))
    ample = summed.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_REFERENCE)
    totals = {r["lang"]: r["n"] for r in ample.collect()}
    words: dict = {}
    classes: dict = {}
    known = ample.select(F.col("lang").alias("known"))
    for r in top.join(known, F.col("lang").eqNullSafe(F.col("known")), "left_semi").orderBy("r").collect():
        if r["kind"] == 1:
            classes.setdefault(r["lang"], np.zeros(N_CLASSES))[int(r["key"])] = r["n"]
        elif r["r"] <= top_words:
            words.setdefault(r["lang"], []).append((r["key"], r["n"]))
    out = {}
    for own, counts in classes.items():
        best = words.get(own, [])
        rest = totals.get(own, 0) - sum(n for _, n in best)
        out[own] = ([w for w, _ in best], np.array([*(n for _, n in best), rest], dtype=float), counts)
    return out


def distances(text: str | None, reference: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Jensen-Shannon distances of one text's character classes and common words from its language's."""
    data = (text or "").encode()
    found = _word_counts(data.translate(_LOWER).split())
    own = np.array([found.get(w.encode(), 0) for w in reference[0]], dtype=float)
    return js_distance(class_counts(data), reference[2]), js_distance(np.append(own, sum(found.values()) - own.sum()), reference[1])


def with_rules(docs: DataFrame, lang: str = "lang", text: str = "text", name: str = "rules") -> DataFrame:
    """``docs`` with a struct ``name``: the base counts, base_failed, both distances (null if not compared), kept."""
    refs = references(docs, lang, text)

    def judge(langs: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for own, value in zip(langs, texts, strict=True):
            stats = base_stats(value)
            failed = stats[0] < BASE_WORDS or 100 * stats[4] > BASE_REPEAT * stats[0]
            near = (None, None)
            reference = refs.get(None if own is None or own != own else own)
            if stats[0] >= MIN_WORDS and reference is not None and reference[1].sum() >= REFERENCE_TIMES * stats[0]:
                near = distances(value, reference)
            far = near[0] is not None and (near[0] > MAX_CLASS_DISTANCE or near[1] > MAX_WORD_DISTANCE + WORD_SPREAD / stats[0] ** 0.5)
            rows.append((*stats, failed, *near, not failed and not far))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"])

    judged = F.pandas_udf(judge, f"{STATS}, base_failed boolean, class_distance double, word_distance double, kept boolean")
    return docs.withColumn(name, judged(F.col(lang), F.col(text)))


def keep_passing(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the divergence."""
    return with_rules(docs, lang, text, "_quill_rules").where("_quill_rules.kept").drop("_quill_rules")
