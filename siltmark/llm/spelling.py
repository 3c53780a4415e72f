"""Words that differ by one letter, and the more frequent form that each leads to.

Of two words that differ by one inserted, deleted or replaced code point, the edit leaves one of the other's two
halves as it is, at the start or at the end. So every word's halves are held by automata, in shards by the
half's hash, and every word is scanned by the shards that can hold a half of a word near to it; a half that is found
where it must be, in a word of a fitting length, is a candidate's, and the distance is verified.

Halves that many words have don't make pairs: what is left of their words is looked up by its forms with one
code point less, which near words share. A half of over PART words is divided into parts, each with a shard of its
own, and is asked for in all of them. Candidates are verified where they are found, and only counts and the best
form leave a task, so the rows that are shuffled follow the number of words, and no pair is a row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, written
from .words import tidy

#: Fixed values of the query's contract: letters, lower-cased letters, the least length and count of a word.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 5, 3

#: Halves in a shard, and words of one half in a part.
SHARD = 1 << 16
PART = 1 << 16
#: Halves of over PART words that are broadcast; with more they are joined.
MOST_BROADCAST = 50_000


def lowered_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", runs: str = LETTERS) -> DataFrame:
    """`key` and every lower-cased run of letters, a row each. A null text has none; a null key stays null."""
    found = F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(runs), F.lit(0))
    return docs.select(F.col(f"`{key}`").alias("key"), F.explode(found).alias("run")).select("key", F.translate("run", UPPER, LOWER).alias("run"))


def counted(words: DataFrame, word: str = "word", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """Distinct words of at least so many code points and occurrences, with their number n."""
    of = words.where(F.length(word) >= least_length).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    return of.where(F.col("n") >= least)


def is_near(x: str, y: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes y of x."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > 1 or x == y:
        return False
    k = 0
    while k < len(y) and x[k] == y[k]:
        k += 1
    return x[k + 1 :] == y[k + (len(x) == len(y)) :]


def _half(word: Column) -> Column:
    return F.floor(F.length(word) / 2).cast("int")


def _asked(word: Column) -> Column:
    """The first and last parts of a word that can be a half of one near to it, as (kind, segment)."""
    size = F.length(word)
    lengths = [size - 1, size, size + 1]
    first = [F.floor(n / 2).cast("int") for n in lengths]
    # from the end, so that parts of the near word stay in place
    last = [F.least(n - F.floor(n / 2), size).cast("int") for n in lengths]
    of = [F.struct(F.lit(0).alias("kind"), F.substring(word, F.lit(1), k).alias("segment")) for k in first]
    of += [F.struct(F.lit(1).alias("kind"), F.substring(word, size - k + 1, k).alias("segment")) for k in last]
    return F.array_distinct(F.array(*of))


def _less(rest: str) -> set[str]:
    """rest, and rest with one code point less: two that differ by one edit share one of these."""
    return {rest, *(rest[:k] + rest[k + 1 :] for k in range(len(rest)))}


class Shard:
    """An automaton over halves, and the words of each by what is left of them."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.rests: dict[tuple[int, str, str], list[tuple[str, int]]] = defaultdict(list)
        self.ready = False

    def hold(self, kind: int, word: str, n: int) -> None:
        half = len(word) // 2
        segment, rest = (word[half:], word[:half]) if kind else (word[:half], word[half:])
        # marks of a word's start and end: a half is found in its place only
        self.automaton.add_word(segment + "$" if kind else "^" + segment, (kind, segment))
        for less in _less(rest):
            self.rests[kind, segment, less].append((word, n))

    def near(self, word: str) -> dict[str, int]:
        """Words held here that are near, each by its half here; one whose first half fits too is left to that half."""
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        found: dict[str, int] = {}
        if not self.rests:
            return found
        for _, (kind, segment) in self.automaton.iter(f"^{word}$"):
            if len(segment) > len(word):
                continue
            rest = word[: len(word) - len(segment)] if kind else word[len(segment) :]
            for less in _less(rest):
                for other, n in self.rests.get((kind, segment, less), ()):
                    if other not in found and is_near(word, other) and not (kind and word.startswith(other[: len(other) // 2])):
                        found[other] = n
        return found


_FOUND = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()), T.StructField("best", T.StringType()), T.StructField("best_n", T.LongType())])


@tidy
def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of shard and part, halves before words that ask; a word that asks twice comes twice in a row."""
    place, shard, last = None, Shard(), None
    for batch in batches:
        out: list[tuple[str, int, str, int]] = []
        for s, p, kind, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (s, p) != place:
                place, shard, last = (s, p), Shard(), None
            if kind >= 0:
                shard.hold(kind, word, n)
            elif word != last:
                last = word
                if found := shard.near(word):
                    most, best = min((-k, w) for w, k in found.items())
                    out.append((word, len(found), best, -most))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=_FOUND.names)


def near_words(words: DataFrame, shard: int = SHARD, part: int = PART) -> DataFrame:
    """Of distinct words with a number n: those that have near words, n_near, and the near word of largest n (ties: the least) as `best`, `best_n`."""
    word = F.col("word")
    held = words.select(
        "word", "n",
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.substring(word, F.lit(1), _half(word)).alias("segment")), F.struct(F.lit(1).alias("kind"), F.substring(word, _half(word) + 1, F.length(word) - _half(word)).alias("segment")))).alias("h"),
    ).select("word", "n", "h.kind", "h.segment")
    large = written(held.groupBy("kind", "segment").count().where(F.col("count") > part).select("kind", "segment", F.ceil(F.col("count") / part).cast("int").alias("parts")), "large-halves")
    shards = max(1, -(-2 * words.count() // shard))
    wide = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    place = F.pmod(F.xxhash64("kind", "segment"), F.lit(shards)).cast("int").alias("shard")
    parts = F.coalesce("parts", F.lit(1))
    keep = held.join(wide, ["kind", "segment"], "left").select(place, F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), "kind", "word", "n")
    asks = words.select("word", "n", F.explode(_asked(word)).alias("a")).select("word", "n", "a.kind", "a.segment").join(wide, ["kind", "segment"], "left")
    asks = asks.select(place, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(-1).alias("kind"), "word", "n")
    # 0 for halves, 1 for words that ask, so that halves come first
    rows = keep.unionByName(asks).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("kind") < 0, "word")
    found = rows.mapInArrow(_scan, _FOUND)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """The last form that each word's forms lead to. Numbers at least double from form to form, so there are few rounds."""
    of = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = of.select(F.col("word").alias("root"), F.col("root").alias("on"))
        new = written(of.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        discard(of)
        of = new.select("word", "root")
        of.written_to = new.written_to
        if not moved:
            return of


def spelling_groups(words: DataFrame, times: float = 2, shard: int = SHARD, part: int = PART) -> DataFrame:
    """Distinct words with a number n, each with its form, root, n_near and form_n.

    The form is the near word of largest n (ties: the first in order of code points) if that is at least `times` the
    word's, else null; the root is the last of the forms of forms, the word itself where it has none. `times` must be
    over 1, so that forms can't lead in a circle. Null words take no part; of repeated rows the n are added. An empty table gives none.
    """
    if times <= 1:
        raise ValueError("times must be over 1")
    words = written(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = written(near_words(words, shard, part), "near-words")
    has = F.col("best_n") >= F.col("n") * times
    found = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
