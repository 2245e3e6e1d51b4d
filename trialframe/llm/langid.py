"""Language identification by bit-sliced Bloom filters over character n-grams.

One table holds the filters of all languages: each slot is a bit mask with a bit for
each language. An n-gram is looked up in a few slots, and the conjunction of their masks
names all languages that contain it at once. Over a text the bits are counted for
each language; a count is corrected by the rate at which that language's filter says
yes to n-grams it does not contain. The largest corrected count decides.

Texts are lower-cased; n-grams run over letters, with word boundaries. A language's
filter holds the n-grams that are frequent enough in it and not rarer than
``DOMINANCE`` of their greatest frequency in any language, which leaves out what
strays in from quotations.

The filters are filled from a bounded sample: at most ``per_language`` documents of
each language (rounded up to a multiple of 16), by least hash; their n-gram counts are gathered in Spark, and at
most ``GRAMS`` n-grams of each language are kept. Predictions cover whole texts of
all rows. NULL texts and texts without a letter are ``und`` with score 0; a text none
of whose n-grams is known gets the language with most training rows, score 0. Ties go
to the name that sorts first. With nothing to learn from, all are ``und``. Rows pass
through, repeated or not.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .arrow import append_columns
from .decontaminate import gram_hashes

PER_LANGUAGE = 3000
GRAMS = 30_000
SIZES = (3, 4)
#: Least share of a language's n-grams of one size for an n-gram to be in its filter.
SHARE = 2e-6
DOMINANCE = 0.2
#: Slots of the table as a power of two, and slots looked up for an n-gram.
LG_SLOTS = 20
HASHES = 3
#: Parts of a language's rows that are sampled apart.
_SHARES = 16
_BLOCK = 1 << 17
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text with one 32 in place of each run of others, and around it."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    padded = np.full(len(codes) + 2, 32, np.uint64)
    padded[1:-1][letter] = codes[letter]
    gap = padded == 32
    return padded[~(gap & np.concatenate([[False], gap[:-1]]))]


def grams_of(codes: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of all sizes; none spans more than one word boundary inside."""
    out = []
    gap = codes == 32
    for i, size in enumerate(SIZES):
        hashed = gram_hashes(codes, size)
        inner = np.zeros(len(hashed), bool)
        for k in range(1, size - 1):
            inner |= gap[k : k + len(hashed)]
        out.append(hashed[~inner] * _MIX[0] + np.uint64(i))
    return np.concatenate(out)


class Filters:
    """The filters of all languages in one table of bit masks."""

    def __init__(self, languages: list[str], fallback: str | None, lg_slots: int = LG_SLOTS) -> None:
        self.languages, self.fallback = languages, fallback
        self.words = max(1, -(-len(languages) // 64))
        self.shift = np.uint64(64 - lg_slots)
        self.table = np.zeros((self.words, 1 << lg_slots), np.uint64)

    def _slots(self, grams: np.ndarray):
        for i in range(HASHES):
            yield ((grams ^ (grams >> np.uint64(31))) * _MIX[i + 1]) >> self.shift

    def add(self, language: int, grams: np.ndarray) -> None:
        word, bit = divmod(language, 64)
        for slots in self._slots(grams):
            self.table[word, np.unique(slots)] |= np.uint64(1) << np.uint64(bit)

    def false_rates(self) -> np.ndarray:
        """For each language, how often its filter says yes to an n-gram drawn at random."""
        rates = []
        for i in range(len(self.languages)):
            word, bit = divmod(i, 64)
            rates.append(float(((self.table[word] >> np.uint64(bit)) & np.uint64(1)).mean()) ** HASHES)
        return np.array(rates)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it."""
        found = None
        for slots in self._slots(grams):
            found = self.table[:, slots] if found is None else found & self.table[:, slots]
        return found

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Bits for each language over the whole text, and the number of n-grams."""
        total, n = np.zeros(len(self.languages), np.int64), 0
        codes = letters_of(text)
        reach = max(SIZES) - 1
        for at in range(0, max(1, len(codes)), _BLOCK):
            part = codes[at : at + _BLOCK + reach]
            # n-grams that start in the overlap belong to the next block
            for i, size in enumerate(SIZES):
                own = part[: _BLOCK + size - 1]
                hashed = gram_hashes(own, size)
                inner = np.zeros(len(hashed), bool)
                for k in range(1, size - 1):
                    inner |= own[k : k + len(hashed)] == 32
                grams = hashed[~inner] * _MIX[0] + np.uint64(i)
                found = self.masks(grams)
                n += len(grams)
                for j in range(len(self.languages)):
                    word, bit = divmod(j, 64)
                    total[j] += int(((found[word] >> np.uint64(bit)) & np.uint64(1)).sum())
        return total, n


def predict(filters: Filters, rates: np.ndarray, text: str | None) -> tuple[str, float]:
    if text is None or not filters.languages or not any(map(str.isalpha, text)):
        return "und", 0.0
    counts, n = filters.counts(text)
    true = np.clip((counts - n * rates) / np.maximum(1 - rates, 1e-9), 0, None)
    if not true.any():
        return filters.fallback or "und", 0.0
    best = int(np.argmax(true))
    # a runner-up that contains nearly as many n-grams leaves little certainty
    odds = (true / true[best]) ** 8
    return filters.languages[best], float(odds[best] / odds.sum())


def learn(documents: DataFrame, training: str = "true", per_language: int = PER_LANGUAGE) -> Filters:
    """Fill the filters from documents with a language for which the SQL condition holds."""
    labelled = documents.where("lang is not null and text is not null").where(training)
    known = labelled.groupBy("lang").count().collect()
    languages = sorted(r.lang for r in known)
    fallback = min(known, key=lambda r: (-r["count"], r.lang)).lang if known else None
    # the least hashes within each of some shares of a language: every task passes on a few
    # rows of each, and texts that repeat count once
    first = Window.partitionBy("lang", "share").orderBy("h")
    chosen = (
        labelled.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
        .withColumn("share", F.pmod("h", F.lit(_SHARES)))
        .withColumn("n", F.row_number().over(first)).where(F.col("n") <= -(-per_language // _SHARES))
        .select("lang", "doc_id", "h")
    )
    texts = labelled.withColumn("h", F.xxhash64("text")).join(chosen, ["lang", "doc_id", "h"], "left_semi").select("lang", "text")

    def run(batches):
        import pyarrow as pa

        from .arrow import pieces

        for whole in batches:
            for batch in pieces(whole, [1]):
                by_lang: dict[str, list] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, parts in by_lang.items():
                    grams, n = np.unique(grams_of(letters_of("\n".join(parts))), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    counts = texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(total), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= SHARE)
    most = share.groupBy("gram").agg(F.max("share").alias("most"))
    rank = Window.partitionBy("lang").orderBy(F.desc("share"), "gram")
    kept = (
        share.join(most, "gram").where(F.col("share") >= DOMINANCE * F.col("most"))
        .withColumn("n", F.row_number().over(rank)).where(F.col("n") <= GRAMS).select("lang", "gram").toPandas()
    )
    filters = Filters(languages, fallback)
    number = {name: i for i, name in enumerate(languages)}
    for lang, grams in kept.groupby("lang")["gram"]:
        filters.add(number[lang], grams.to_numpy(np.int64).view(np.uint64))
    return filters


def identify(documents: DataFrame, filters: Filters, keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred and score."""

    def make():
        rates = filters.false_rates()

        def work(texts):
            found = [predict(filters, rates, t) for t in texts]
            return [[x[0] for x in found], [x[1] for x in found]]

        return work

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append_columns(documents, ["text"], new, make, keep)


HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"


def held_out_languages(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    filters = learn(documents, f"doc_id is not null and NOT ({HELD_OUT})", per_language)
    found = identify(documents, filters, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "lang_pred", "score")
