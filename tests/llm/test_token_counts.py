"""Token counts of a whole table against greedy pieces of the library's own words, and odd rows."""

from functools import lru_cache

from tokenizers import Tokenizer

from kindred.llm import wordpiece
from kindred.llm.queries import op6_token_counts, word_bpe


def counter():
    library = Tokenizer.from_file(word_bpe())
    names = set(library.get_vocab())

    @lru_cache(maxsize=None)
    def pieces(word: str) -> int:
        symbols = [*word[:-1], word[-1] + "</w>"]
        at = n = 0
        while at < len(symbols):
            at = next(e for e in range(len(symbols), at, -1) if "".join(symbols[at:e]) in names)
            n += 1
        return n

    def count(text: str | None) -> int:
        plain = library.normalizer.normalize_str(text or "") if library.normalizer else text or ""
        return sum(pieces(w) for w, _ in library.pre_tokenizer.pre_tokenize_str(plain))

    return count


def test_every_document(spark, sf):
    count = counter()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in op6_token_counts(spark, sf).collect()}
    assert got == {i: count(t) for i, t in docs.items()}


def test_odd_rows(spark):
    count = counter()
    rows = [(1, "Some words, 12 of them?", "x"), (1, "Some words, 12 of them?", "x"), (1, "other", "x"), (None, "naïve 日本", "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n ", "x"), (5, "ab " * 300_000, "x"), (6, "q" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = wordpiece.token_counts(df, word_bpe())
    assert got.columns == ["doc_id", "n_tokens"]
    shown = sorted(((r.doc_id or 0, r.n_tokens) for r in got.collect()))
    assert shown == sorted((i or 0, 300_000 * count("ab") if i == 5 else wordpiece.counter(word_bpe()).count(t) if i == 6 else count(t)) for i, t, _ in rows)
    assert wordpiece.token_counts(df.limit(0), word_bpe()).count() == 0
