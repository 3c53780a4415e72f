"""Language identification by compression.

For each language a zstandard dictionary of raw content is filled from a bounded sample of
labelled texts. A text is encoded with each dictionary, and the language whose dictionary
gives the smallest result is chosen. Long texts are encoded in pieces, so that a text's own
repetitions don't drown what the dictionary saves.

A choice is rejected where the margin is narrow for the text's length: the next language's size
must be larger by a part of the best size, and the best size itself not larger than texts of
that language need. Both limits are learned from sampled texts that are in no dictionary.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import tidy

#: Texts sampled for each language, and characters taken of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 256, 512
#: Bytes of a dictionary at most.
DICTIONARY_BYTES = 96 * 1024
LANGUAGES = 1000
#: Bytes of a piece.
PIECE = 512
LEVEL = 9
#: A prediction of no higher score is rejected: at 0.5 a limit is just met.
MARGIN = 0.5
#: Texts for the limits of each language (about) and of all, texts from which a language has its own, and bytes at which they are cut.
LIMIT_TEXTS, LIMIT_TOTAL, LIMIT_OWN, LENGTHS = 64, 2048, 12, (16, 32, 64, 128, 256, 512)
#: The gap to the next language is half of what all but a part of the texts have, within these bounds.
TAIL, GAPS = 0.02, (0.03, 0.1)
#: Bytes for a byte of text: as all but a part of the texts need, and a tenth more.
ROOM = 1.1
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_AT = np.log(LENGTHS)


def normal(text: str | None) -> str:
    """Lower case, letters only; other characters, numerals such as those of powers and fractions among them, are single spaces."""
    clean = _OTHER.sub(" ", (text or "").lower())
    if not clean.isascii() and not clean.replace(" ", "").isalpha():
        clean = _OTHER.sub(" ", "".join(c if c.isalpha() else " " for c in clean))
    return clean.strip()


class Dictionaries(dict):
    """Dictionaries by language; limits has (gaps, parts) by language, and by None for those with few texts, at LENGTHS."""

    limits: dict[str | None, tuple[list[float], list[float]]] = {}


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> Dictionaries:
    """A dictionary for each language, the most frequent first, from rows with text and language.

    Texts are chosen by a hash of key and text, the first texts + LIMIT_TEXTS of each of at most
    LANGUAGES languages, so rows that repeat, share a key or have none neither crowd out others nor
    add to what reaches the driver; of each, chars characters from a place set by the hash are taken.
    A count of rows by language lets most rows go before; where too few are left, all rows of that
    language are looked at. The texts for the limits, set by the hash, are in no dictionary.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    if not counts:
        return Dictionaries()
    most = texts + LIMIT_TEXTS
    h = F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("language"))
    room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    place = F.pmod(F.xxhash64(h), room.cast("long")).cast("int") + 1
    drawn = rows.select(F.col(lang).alias("lang"), h.alias("h"), F.substring(F.col(text), place, F.lit(chars)).alias("piece"))

    def first(of: DataFrame) -> list[tuple]:
        single = of.groupBy("lang", "h").agg(F.min("piece").alias("piece"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        return [tuple(r) for r in single.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "h", "piece").collect()]

    # the hashes' lower end: four times as many as are needed
    reach = F.element_at(F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, int(min(1.0, 4 * most / n) * (1 << 62)))]), F.col("lang"))
    picked = first(drawn.where(F.shiftrightunsigned("h", 2) < reach))
    found = Counter(r[0] for r in picked)
    few = [l for l, n in counts.items() if found[l] < min(n, most) and n > 4 * most]
    if few:
        picked = [r for r in picked if r[0] not in few] + first(drawn.where(F.col("lang").isin(few)))
    out: dict[str, list[str]] = {}
    apart: dict[str, list[str]] = {}
    for l, h_, piece in sorted(picked):
        if clean := normal(piece):
            (apart if (h_ >> 32) % (texts + LIMIT_TEXTS) < LIMIT_TEXTS else out).setdefault(l, []).append(clean)
    for l in apart.keys() - out.keys():
        out[l] = apart.pop(l)
    made = Dictionaries({l: " ".join(out[l]).encode()[:DICTIONARY_BYTES] for l in sorted(out, key=lambda l: (-counts[l], l))})
    made.limits = limits_of(made, apart)
    return made


def limits_of(dictionaries: dict[str, bytes], apart: dict[str, list[str]]) -> dict[str | None, tuple[list[float], list[float]]]:
    """(gaps, parts) of the texts apart that are told right, at LENGTHS, for languages with enough of them and for all (None)."""
    model = Model(dictionaries)
    most = min(LIMIT_TEXTS, max(2, LIMIT_TOTAL // max(1, len(dictionaries))))
    seen: dict[str | None, list[list[tuple[float, float]]]] = {}
    for k, l in enumerate(model.languages):
        for piece in apart.get(l, [])[:most]:
            raw = piece.encode()
            for i, n in enumerate(LENGTHS):
                if len(raw) >= n:
                    sizes = model.sizes(raw[:n])
                    best, gap = narrowest(sizes)
                    if sizes[k] == sizes[best]:
                        for name in (l, None):
                            seen.setdefault(name, [[] for _ in LENGTHS])[i].append((gap, sizes[k] / n))
    out = {}
    for name, by in seen.items():
        if name is not None and len(by[0]) < LIMIT_OWN:
            continue
        gaps, parts = [], []
        for at, every in zip(by, seen[None], strict=True):
            found = np.array(at if len(at) >= LIMIT_OWN else every)
            gaps.append(float(np.clip(np.quantile(found[:, 0], TAIL, method="lower") / 2, *GAPS)) if len(found) else GAPS[0])
            parts.append(float(np.quantile(found[:, 1], 1 - TAIL, method="higher") * ROOM) if len(found) else parts[-1] if parts else np.inf)
        out[name] = gaps, parts
    return out


def narrowest(sizes: list[int]) -> tuple[int, float]:
    """The first of the smallest sizes, and the part by which the next is larger."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    return best, min((s for i, s in enumerate(sizes) if i != best), default=np.inf) / sizes[best] - 1


class Model:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.encoders = []
        for l in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[l], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

        limits = getattr(dictionaries, "limits", {})
        plain = [GAPS[0]] * len(LENGTHS), [np.inf] * len(LENGTHS)
        self.limits = [limits.get(l, limits.get(None, plain)) for l in self.languages]

    def sizes(self, raw: bytes) -> list[int]:
        pieces = [raw[a : a + PIECE] for a in range(0, len(raw), PIECE)]
        return [sum(len(e.compress(p)) for p in pieces) for e in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language, and a score: 0.5 where the gap to the next language or the size just meets its limit, 0 at a tie."""
        clean = normal(text)
        if not clean or not self.encoders:
            return UNKNOWN, 0.0
        raw = clean.encode("utf-8", "replace")
        sizes = self.sizes(raw)
        best, gap = narrowest(sizes)
        least, part = (float(np.interp(np.log(len(raw)), _AT, x)) for x in self.limits[best])
        times = min(gap / least, (part * len(raw) / sizes[best]) ** 8, 1e9)
        return self.languages[best], times / (1 + times)


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: list[str] | None = None, margin: float = MARGIN) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected (score not over margin, or und).

    A text that is null or has no letter is und with score 0. Ties go to the language first
    in the model, the most frequent one. Columns named as a result are replaced; repeated rows each get a row; without
    any dictionary all is und.
    """
    made = RESULT.names
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    columns = keep if text in keep else [*keep, text]
    source = docs.select(*[f"`{c}`" for c in columns])
    schema = T.StructType([*[source.schema[c] for c in keep], *RESULT])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    index = columns.index(text)

    @tidy
    def run(batches):
        model = Model(shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(index)]
            kept = [batch.column(k) for k in range(len(keep))]
            langs, scores = pa.array([l for l, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            rejected = pa.array([l == UNKNOWN or s <= margin for l, s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*kept, langs, scores, rejected], [*keep, *made])

    return source.mapInArrow(run, schema)


def held_out(docs: DataFrame, key: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
