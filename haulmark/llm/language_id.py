"""Language identification by a language-bitmask n-gram filter.

For every learned language the set of its character trigrams goes into a Bloom filter; the filters
of all languages share their hash positions and lie side by side, bit-sliced: entry ``p`` of the
table holds one bit for each language.  One lookup, the AND over a trigram's positions, gives all
languages that contain it.  A text is decided by the number of its trigrams in each language; the
expected false positives (fill of the language's slice to the power of the hash count) are taken
off first.

Trigrams are taken from the lower-cased text with everything but letters read as a space, and only
those with a letter in the middle, so none reaches over a word.  A trigram counts as one of a
language when its rate there is at least ``MIN_RATE`` and at least ``SHARE`` of its highest rate in
any language; rates are over all learned rows, and a language has at most 1 / ``MIN_RATE`` of them,
which bounds the table whatever the input.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text with no
known trigram gets the language with most training trigrams and score 0; with nothing learned all
texts are ``und``; equal counts go to the language first by code point; repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.tables import keep
from haulmark.llm.tokens import mix

MIN_RATE = 1e-5
SHARE = 0.25
HASHES = 3
SLOTS_PER_GRAM = 12
SLICE_CHARS = 1 << 20
FLUSH_GRAMS = 1 << 20
UNKNOWN = "und"

_MIDDLE = np.uint64(21)
_OUTER = np.uint64(42)
_SPACE = 32
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def text_slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > limit:
            yield first, i
            first = i
            size = 0
        size += len(text or "") + 1
    if first < len(texts):
        yield first, len(texts)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of the texts one after the other, and where each text's begin."""
    lowered = [(t or "").lower() for t in texts]
    bounds = np.cumsum([0] + [len(t) + 2 for t in lowered])
    points = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le"), np.uint32)
    points = np.where(_is_letter()[points], points, np.uint32(_SPACE)).astype(np.uint64)
    at = np.flatnonzero(points[1:-1] != _SPACE) + 1
    grams = (points[at - 1] << _OUTER) | (points[at] << _MIDDLE) | points[at + 1]
    return grams, np.searchsorted(at, bounds)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram and n over all rows (lang, text); rows are counted where they lie first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def merged(parts):
            grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(where, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)

        def rows(lang):
            grams, n = merged(seen.pop(lang))
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
            )

        for batch in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                for first, last in text_slices(texts):
                    seen[lang].append(np.unique(trigrams(texts[first:last])[0], return_counts=True))
                if len(seen[lang]) > 16:
                    seen[lang] = [merged(seen[lang])]
                if sum(len(p[0]) for p in seen[lang]) > FLUSH_GRAMS:
                    yield rows(lang)
        for lang in list(seen):
            yield rows(lang)

    counted = docs.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counted = counted.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filter:
    """Bit-sliced Bloom filters; entry p of table g has a bit for each language of group g.

    Groups hold 64 languages; up to eight languages fit one table of bytes.
    """

    langs: list[str]
    tables: list[np.ndarray]
    false_rate: np.ndarray
    fallback: int

    @classmethod
    def build(cls, langs: list[str], totals: list[int], gram: np.ndarray, lang: np.ndarray) -> Filter:
        n = len(np.unique(gram))
        slots = 1 << max(10, int(np.ceil(np.log2(max(n, 1) * SLOTS_PER_GRAM))))
        kind, width = (np.uint8, 8) if len(langs) <= 8 else (np.uint64, 64)
        tables = [np.zeros(slots, kind) for _ in range(0, len(langs), width)]
        fill = np.zeros(len(langs))
        for number in range(len(langs)):
            table = tables[number // width]
            bit = kind(1 << (number % width))
            for at in _positions(gram[lang == number], slots):
                table[at] |= bit
            fill[number] = np.count_nonzero(table & bit) / slots
        return cls(langs, tables, fill**HASHES, int(np.argmax(totals)) if totals else 0)

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, ptr = trigrams(texts)
        n = np.diff(ptr)
        hits = np.zeros((len(texts), len(self.langs)))
        places = list(_positions(grams, len(self.tables[0])))
        filled = np.flatnonzero(n)
        width = 8 if self.tables[0].dtype == np.uint8 else 64
        for group, table in enumerate(self.tables):
            found = table[places[0]]
            for at in places[1:]:
                found &= table[at]
            for number in range(group * width, min(len(self.langs), (group + 1) * width)):
                bit = (found >> found.dtype.type(number % width)) & found.dtype.type(1)
                if len(filled):
                    hits[filled, number] = np.add.reduceat(bit, ptr[:-1][filled], dtype=np.int64)
        true = np.maximum((hits - n[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.99)), 0)
        total = true.sum(1)
        best = np.where(total > 0, true.argmax(1), self.fallback)
        score = np.where(total > 0, true.max(1) / np.maximum(total, 1e-12), 0.0)
        known = n > 0
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def _positions(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    one = mix(grams)
    step = (one >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((one + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)


def learn(docs: DataFrame, min_rate: float = MIN_RATE, share: float = SHARE) -> Filter:
    """Filter from all rows (lang, text) of ``docs``."""
    counts = keep(gram_counts(docs), "gram-counts")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    langs = sorted(totals)
    if not langs:
        return Filter([], [], np.zeros(0), 0)
    size = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(float(totals[lang])))])
    rates = counts.withColumn("rate", F.col("n") / size[F.col("lang")]).where(F.col("rate") >= min_rate)
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rates.join(top, "gram").where(F.col("rate") >= share * F.col("top"))
    # At most 1 / min_rate trigrams of each language are left.
    rows = kept.select("gram", "lang").orderBy("lang", "gram").toArrow()
    number = {lang: i for i, lang in enumerate(langs)}
    code = np.array([number[x] for x in rows.column("lang").to_pylist()], dtype=np.int64)
    return Filter.build(langs, [totals[x] for x in langs], rows.column("gram").to_numpy().astype(np.uint64), code)


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred and score for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in text_slices(texts):
                pred, score = model.decide(texts[first:last])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
