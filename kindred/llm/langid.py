"""Language ID by rank order: a text's most frequent character n-grams against each language's.

Words are runs of letters, lower-cased, with a blank before and after; n-grams of one to
three characters stay within them. A profile ranks the most frequent n-grams. A text goes
to the language with the least out-of-place distance: the sum over the text's profile of
how far each n-gram's rank is from its rank in the language, or the profile's size where
the language lacks it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workers import claim

PROFILE = 300
UNDETERMINED = "und"
#: Distinct words, over all languages, that a Python worker counts before it hands their n-grams on.
MOST_WORDS = 40_000
#: Languages that may be learnt; a table with more labels than this is refused, not cut.
MOST_LANGUAGES = 5_000
#: Share of labelled rows that may lie under the score that a least score starts from, the
#: part of that score that is asked for, and the number of labelled rows at which half of
#: it is trusted.
BELOW, PART, TRUST = 0.01, 0.6, 20
#: Steps in which scores from 0 to 1 are counted.
STEPS = 100_000
_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Numbers that Python counts as word characters, such as
    superscripts, fractions and Roman numeral signs, are no letters."""
    words = _WORDS.findall(text.lower()) if text else []
    return words if "".join(words).isalpha() else [w for word in words for w in _LETTERS.findall(word)]


def _windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, pairs, triples) of words with one blank before, between and after them."""
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    return c, two, two[:-1] << 21 | c[2:]


def gram_counts(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted n-grams, counts) of words that come so many times each.

    n-grams are integers: up to three code points of 21 bits, shorter ones with zeros before.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c, two, three = _windows(list(words))
    letter = c != 32
    times = np.zeros(len(c), np.int64)
    times[letter] = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    weights = np.concatenate([times[letter], np.maximum(times[:-1], times[1:]), times[1:-1][letter[1:-1]]])
    grams, at = np.unique(np.concatenate([c[letter], two, three[letter[1:-1]]]), return_inverse=True)
    return grams, np.bincount(at, weights, len(grams)).astype(np.int64)


def text_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for the words of one text as they stand."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c, two, three = _windows(words)
    letter = c != 32
    grams = np.concatenate([c[letter], two, three[letter[1:-1]]])
    grams.sort()
    ends = np.flatnonzero(np.append(grams[1:] != grams[:-1], True))
    return grams[ends], np.diff(ends, prepend=-1)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent of sorted n-grams, ties by the smaller one."""
    if len(counts) > size:
        often = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[often], counts[often]
    return grams[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    grams: np.ndarray  # every n-gram of any profile, sorted
    ranks: np.ndarray  # language x n-gram; size where absent
    size: int

    def predict(self, words: list[str]) -> tuple[str, float]:
        own = ranked(*text_counts(words), self.size)
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        theirs = np.where(self.grams[at] == own, self.ranks[:, at], self.size)
        away = np.where(theirs == self.size, self.size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.languages[best], 1.0 - float(away[best]) / (self.size * len(own))


def learn(docs: DataFrame, *, size: int = PROFILE, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from all rows with a language; n-grams are counted over their whole texts.

    Only the profiles (size n-grams for each language) come to the driver. Null texts and
    null languages teach nothing; without any language the profiles are empty. A worker
    holds the words of one text and MOST_WORDS others at once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        held: dict[str, Counter] = {}
        n = 0
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = held.setdefault(name, Counter())
                before = len(words)
                words.update(words_of(t.as_py()))
                n += len(words) - before
                if n > MOST_WORDS:
                    yield from map(out, held, held.values())
                    held, n = {}, 0
        yield from map(out, held, held.values())

    def out(name, words):
        grams, counts = gram_counts(words)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text)
    sums = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).select("lang", "gram", "rank").limit(size * MOST_LANGUAGES + 1).collect()
    if len(rows) > size * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    languages = sorted({r.lang for r in rows})
    place = {name: i for i, name in enumerate(languages)}
    grams = np.unique(np.array([r.gram for r in rows], np.int64))
    ranks = np.full((len(languages), len(grams)), size, np.int64)
    for r in rows:
        ranks[place[r.lang], np.searchsorted(grams, r.gram)] = r["rank"] - 1
    return Profiles(languages, grams, ranks, size)


def identify(docs: DataFrame, profiles: Profiles, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text; nothing but the text is looked at.

    score: 1 less the distance over its largest value. Null texts, texts without a letter
    and empty profiles give 'und' and 0; equal distances go to the first language by name.
    A text is read whole, whatever its length; a worker holds the n-grams of one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        for batch in batches:
            found = [profiles.predict(words_of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, lang_pred string, score double")


def least_score(docs: DataFrame, profiles: Profiles, *, below: float = BELOW, part: float = PART, text: str = "text", lang: str = "lang") -> float:
    """Score under which a text is in none of the profiles' languages.

    Fitted on all labelled rows: part of the score that all but a share of below of those
    with a letter reach, rounded down to 1 / STEPS. Profiles learnt from few rows know those
    rows by heart, so with n rows it is lowered by n / (n + TRUST). 0 without labelled rows.
    Only counts of scores, STEPS + 1 at most, come to the driver.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if not profiles.languages:
        return 0.0
    scored = identify(known.select(F.lit(0).alias("key"), text), profiles, key="key", text=text)
    step = F.when(F.col("lang_pred") != UNDETERMINED, F.floor(F.col("score") * STEPS))
    counts = {r.step: r["n"] for r in scored.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, n_und = sum(counts.values()), counts.pop(None, 0)
    if n == n_und:
        return 0.0
    reached, under = below * (n - n_und), 0
    for found in sorted(counts):
        under += counts[found]
        if under >= reached:
            break
    return part * (found / STEPS) * n / (n + TRUST)


def keep_known(docs: DataFrame, profiles: Profiles, *, least: float = 0.0, languages: Collection[str] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of docs whose language is found with a score of least or more, with it in lang.

    languages: those to keep, by default all that were learnt. Rows without a letter (null
    texts, too) go, as do texts that no profile fits. Without profiles all others stay with
    the lang they have, as nothing speaks against them. Other columns, and the order of all,
    stay; a table without lang gets none. Nothing is shuffled or joined: a row is judged
    where it was read.
    """
    wanted = None if languages is None else frozenset(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        for batch in batches:
            found = [language_of(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            at = batch.schema.get_field_index(lang)
            if at >= 0 and profiles.languages:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(found, pa.string()).cast(batch.schema.field(at).type))
            yield batch.filter(pa.array([f is not None for f in found], pa.bool_()))

    def language_of(value: str | None) -> str | None:
        words = words_of(value)  # of one text at a time
        if not words or not profiles.languages:
            return "" if words else None
        name, score = profiles.predict(words)
        return name if score >= least and (wanted is None or name in wanted) else None

    return docs.mapInArrow(run, docs.schema)


def held_out(key: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
