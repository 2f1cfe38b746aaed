"""Text features: word and character n-grams, vocabulary, TF-IDF.

``space`` is ``word`` or ``char``. The terms of a text are counted where the text is. For a vocabulary a task adds up its texts, and only
sums by term are shuffled. For weights the vocabulary goes to the tasks, and a text becomes a sparse row without any shuffle. A vocabulary that
is too large to be sent is joined with long tables ``(row_id, space, term, tf)`` instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import materialize
from .numbering import consecutive, first_rows, nth_largest

# A token is a run of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"

WORD_FEATURES = 100_000
CHAR_FEATURES = 150_000
# A vocabulary of more bytes is not sent to the tasks; a task holds about ten times as much as a dictionary.
MAX_SENT_BYTES = 32 * 1024 * 1024
# A task that counts terms hands on what it has when it holds so many.
MAX_LOCAL_TERMS = 400_000
# Entries of sparse rows that a task hands on at a time.
BATCH_ENTRIES = 1 << 18
# Keys of rows are sent to all tasks up to this many.
MAX_SENT_KEYS = 1_000_000

_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def word_ngrams(text: Column, low: int = 1, high: int = 2) -> Column:
    """Token n-grams for each n from ``low`` to ``high``, joined by one blank."""
    tokens = word_tokens(text)

    def grams(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
        built = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
        return F.when(F.size(tokens) >= n, built).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(n) for n in range(low, high + 1)])


def _padded_words(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), _BLANKS), lambda w: w != "")
    return F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def _word_char_grams(word: Column, low: int, high: int) -> Column:
    """N-grams of one padded word. A word shorter than ``low`` yields itself once."""

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
        built = F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))
        return built if n == low else F.when(F.length(word) >= n, built).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(n) for n in range(low, high + 1)])


def char_wb_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    return F.flatten(F.transform(_padded_words(text), lambda w: _word_char_grams(w, low, high)))


def word_terms(df: DataFrame, low: int = 1, high: int = 2) -> DataFrame:
    """Tokens are cut once per row; the bigrams pair each token with the next one. The counts of a row are made where the row is."""
    if (low, high) == (1, 2):
        return _counted_in_rows(df, word_tokens(F.col("text")), _token_counts, "word")
    exploded = df.select("row_id", "text").repartition("row_id").select("row_id", F.explode(word_ngrams(F.col("text"), low, high)).alias("term"))
    return exploded.groupBy("row_id", "term").agg(F.count("*").alias("tf")).select("row_id", F.lit("word").alias("space"), "term", "tf")


def char_terms(df: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """N-grams are cut once per distinct word of some texts. As for words, a row is counted where it is."""
    if (low, high) == (3, 5):
        return _counted_in_rows(df, F.filter(F.split(F.lower("text"), _BLANKS), lambda w: w != ""), _gram_counts, "char")
    words = df.select("row_id", "text").repartition("row_id").select("row_id", F.explode(_padded_words(F.col("text"))).alias("word")).groupBy("row_id", "word").agg(
        F.count("*").alias("n")
    )
    grams = words.select("row_id", "n", F.explode(_word_char_grams(F.col("word"), low, high)).alias("term"))
    return grams.groupBy("row_id", "term").agg(F.sum("n").alias("tf")).select(
        "row_id", F.lit("char").alias("space"), "term", "tf"
    )


def text_terms(df: DataFrame) -> DataFrame:
    return word_terms(df).unionByName(char_terms(df))


# ---- terms counted inside a task -------------------------------------------------------------

# The same tokens as TOKEN: for Python, a word character is a letter, a digit or an underscore.
_TOKEN = re.compile(r"\w{2,}")


def char_grams(word: str, low: int = 3, high: int = 5) -> list[str]:
    """N-grams of one word with a blank on both sides; a shorter one yields itself once."""
    padded = f" {word} "
    grams = [padded[i : i + low] for i in range(max(len(padded) - low + 1, 1))]
    for n in range(low + 1, high + 1):
        grams += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return grams


def _occurrences(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, without those below 0, and how often each occurs."""
    found, times = np.unique(numbers, return_counts=True)
    first = int(np.searchsorted(found, 0))
    return found[first:], times[first:]


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """One number for each token and its successor; -1 where one of the two has none."""
    return np.where((tokens[:-1] >= 0) & (tokens[1:] >= 0), tokens[:-1] << 32 | tokens[1:], -1)


#: Characters are numbered in this many bits, so that an n-gram of five is one number.
_CHAR_BITS = 12
MAX_CHARS = (1 << _CHAR_BITS) - 1
_BLANK = 1
_SPACES = np.zeros(0x110000, bool)
_SPACES[[c for c in range(0x3001) if chr(c).isspace()]] = True


class Alphabet:
    """Numbers of characters, from 2 on; 1 is the blank around a word, 0 stands for a character without a number."""

    def __init__(self, characters: Iterable[str] = ()):
        self.of = np.zeros(0x110000, np.int64)
        self.of[0x20] = _BLANK
        self.characters = ["", " "]
        self.add(np.array([ord(c) for c in characters], np.uint32))

    def add(self, codes: np.ndarray) -> bool:
        """Numbers the characters that have none; False, and nothing changes, if there would be too many."""
        new = np.unique(codes[(self.of[codes] == 0)])
        if len(self.characters) + len(new) > MAX_CHARS:
            return False
        self.of[new] = np.arange(len(self.characters), len(self.characters) + len(new))
        self.characters += [chr(c) for c in new.tolist()]
        return True

    def key(self, gram: str) -> int:
        number = len(gram) - 3
        for c in gram:
            number = number << _CHAR_BITS | int(self.of[ord(c)])
        return number

    def gram(self, key: int) -> str:
        size = 3
        while key >> _CHAR_BITS * size != size - 3:
            size += 1
        return "".join(self.characters[key >> _CHAR_BITS * n & MAX_CHARS] for n in range(size - 1, -1, -1))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_keys(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One number for each character n-gram (3 to 5) of each word with a blank on both sides, as ``char_grams``; only of numbered characters."""
    inside = ~_SPACES[codes]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    return _owned_grams(codes[inside], np.cumsum(starts)[inside], of)[0]


def _word_grams(codes: np.ndarray, of: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``gram_keys`` of words with one blank between them, and the number of the word that each belongs to."""
    blank = codes == 0x20
    if int(blank.sum()) != max(n_words - 1, 0):
        raise ValueError("A word holds a blank.")
    return _owned_grams(codes[~blank], (np.cumsum(blank) + 1)[~blank], of)


def _owned_grams(codes: np.ndarray, word: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams of words, whose characters are ``codes`` and whose numbers (from 1 on) ``word``; and their words, from 0 on."""
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.bincount(word)[1:] + 2
    padded = np.full(int(lengths.sum()), _BLANK, np.int64)
    padded[np.arange(len(word)) + 2 * word - 1] = of[codes]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    known = padded > 0
    keys, whole, found, owners = padded, known, [], []
    for n in range(2, 6):
        keys = keys[:-1] << _CHAR_BITS | padded[n - 1 :]
        whole = whole[:-1] & known[n - 1 :]
        if n >= 3:
            kept = whole & (owner[: len(keys)] == owner[n - 1 :])
            found.append((keys | (n - 3) << _CHAR_BITS * n)[kept])
            owners.append(owner[: len(keys)][kept])
    return np.concatenate(found), np.concatenate(owners)


def gram_strings(keys: np.ndarray, alphabet: Alphabet) -> pa.Array:
    """The n-grams behind ``keys``, in their order."""
    if alphabet.of[0]:
        # A string that ends in NUL would lose it below.
        return pa.array([alphabet.gram(k) for k in keys.tolist()], pa.string())
    codes = np.array([ord(c) if c else 0 for c in alphabet.characters], np.uint32)
    at, parts = [], []
    for n in range(3, 6):
        mine = np.flatnonzero(keys >> _CHAR_BITS * n == n - 3)
        letters = np.stack([codes[keys[mine] >> _CHAR_BITS * k & MAX_CHARS] for k in range(n - 1, -1, -1)], axis=1)
        at.append(mine)
        parts.append(pa.array(np.ascontiguousarray(letters).view(f"<U{n}").ravel(), pa.string()))
    # The letters of a longer n-gram are above those of a shorter one, so every key is of one length.
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(at))))


def _slices_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of ``BATCH_ENTRIES`` cells together, or of one row that has more."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + BATCH_ENTRIES, "right")))
        yield low, high
        low = high


def _token_counts(cells: pa.ListArray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """For the tokens of some texts: text, token or pair of neighbouring tokens, and how often."""
    coded = cells.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(cells)), pc.fill_null(pc.list_value_length(cells), 0).to_numpy())
    # A token alone stands before its pairs: (text, token, 0), and (text, token, successor + 1).
    base, last = max(len(names), 1), len(names) + 1
    keys = (text * base + codes) * last
    paired = np.flatnonzero(text[:-1] == text[1:])
    found, times = np.unique(np.concatenate([keys, keys[paired] + codes[paired + 1] + 1]), return_counts=True)
    second, first = found % last - 1, found // last % base
    single = second < 0
    joined = pc.binary_join_element_wise(names.take(pa.array(first[~single])), names.take(pa.array(second[~single])), " ")
    place = np.where(single, np.cumsum(single), single.sum() + np.cumsum(~single)) - 1
    terms = pa.concat_arrays([names.take(pa.array(first[single])), joined]).take(pa.array(place))
    yield found // (last * base), terms, times


def _gram_counts(cells: pa.ListArray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """As ``_token_counts`` for the character n-grams of words."""
    coded = cells.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    text = np.repeat(np.arange(len(cells)), pc.fill_null(pc.list_value_length(cells), 0).to_numpy())
    alphabet = Alphabet()
    points = code_points(" ".join(words.to_pylist()))
    if not alphabet.add(points):
        if len(cells) > 1:
            half = len(cells) // 2
            for first, part in ((0, cells.slice(0, half)), (half, cells.slice(half))):
                for at, terms, times in _gram_counts(part):
                    yield at + first, terms, times
            return
        # A text of more characters than can be numbered.
        counts = Counter(g for w in cells.flatten().to_pylist() for g in char_grams(w))
        yield np.zeros(len(counts), np.int64), pa.array(list(counts), pa.string()), np.array(list(counts.values()), np.int64)
        return
    keys, owner = _word_grams(points, alphabet.of, len(words))
    distinct, numbers = np.unique(keys, return_inverse=True)
    numbers = numbers[np.argsort(owner, kind="stable")]
    sizes = np.bincount(owner, minlength=len(words))
    starts = np.cumsum(sizes) - sizes
    # The n-grams of every occurrence of a word.
    often = sizes[codes]
    at = np.arange(often.sum()) + np.repeat(starts[codes] - (np.cumsum(often) - often), often)
    found, times = np.unique(np.repeat(text, often) * max(len(distinct), 1) + numbers[at], return_counts=True)
    terms = gram_strings(distinct, alphabet).take(pa.array(found % max(len(distinct), 1)))
    yield found // max(len(distinct), 1), terms, times


def _counted_in_rows(df: DataFrame, cells: Column, count: Callable, space: str) -> DataFrame:
    """``(row_id, space, term, tf)``: the terms that ``count`` makes of the ``cells`` of a row. Rows of one ``row_id`` are counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("row_id"), batch.column("cells")
            for low, high in _slices_of(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()):
                for text, terms, times in count(lists.slice(low, high - low)):
                    # A cell may have more than ten n-grams.
                    for first in range(0, len(text), 4 * BATCH_ENTRIES):
                        rows = pa.array(text[first : first + 4 * BATCH_ENTRIES] + low)
                        part = [ids.take(rows), pa.repeat(space, len(rows)), terms.slice(first, len(rows)), pa.array(times[first : first + len(rows)])]
                        yield pa.RecordBatch.from_arrays(part, names=["row_id", "space", "term", "tf"])

    schema = f"row_id {df.schema['row_id'].dataType.simpleString()}, space string, term string, tf bigint"
    counted = lambda part: part.select("row_id", cells.alias("cells")).mapInArrow(run, schema)
    rows = dealt_out(df.select("row_id", "text"))
    repeated = materialize(df.groupBy("row_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row_id").alias("repeated")), "repeated-keys")
    n_repeated = repeated.count()
    if not n_repeated:
        return counted(rows)
    keys = F.broadcast(repeated) if n_repeated <= MAX_SENT_KEYS else repeated
    same = F.col("row_id").eqNullSafe(F.col("repeated"))
    several = counted(rows.join(keys, same, "left_semi")).groupBy("row_id", "space", "term").agg(F.sum("tf").alias("tf"))
    return counted(rows.join(keys, same, "left_anti")).unionByName(several)


#: Terms are dealt out by their hash to so many parts of each space, which are added up one after the other.
PARTS = 1 << 12


def _part_numbers(terms: pa.StringArray) -> np.ndarray:
    """A hash of the length and of the first and last eight bytes of each term."""
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2], np.uint8)[: ends[-1]]
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[8:-8] = data
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    sizes = np.diff(ends)
    spare = (8 * (8 - np.clip(sizes, 1, 8))).astype(np.uint64)
    number = (eight[ends[:-1] + 8] << spare) * np.uint64(0x9E3779B97F4A7C15)
    number = (number ^ number >> np.uint64(29) ^ eight[ends[1:]] >> spare) * np.uint64(0xBF58476D1CE4E5B9)
    number = (number ^ number >> np.uint64(32) ^ sizes.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    return (number >> np.uint64(52)).astype(np.uint16)


def _table(space: str, terms: list[str] | pa.Array, df: np.ndarray, cf: np.ndarray) -> pa.RecordBatch:
    terms = terms if isinstance(terms, pa.Array) else pa.array(terms, pa.string())
    return pa.RecordBatch.from_arrays([pa.repeat(space, len(terms)), terms, pa.array(df), pa.array(cf)], names=["space", "term", "df", "cf"])


def _in_parts(table: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of distinct terms of one space as one row for each part: its terms by lines, which no term has in it, and their counts as bytes."""
    part = _part_numbers(table.column("term"))
    order = np.argsort(part, kind="stable")
    numbers, firsts = np.unique(part[order], return_index=True)
    ends = np.append(firsts, len(part)).astype(np.int32)
    terms = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), table.column("term").take(pa.array(order))), "\n")
    counts = []
    for name in ("df", "cf"):
        values = np.ascontiguousarray(table.column(name).to_numpy()[order])
        counts.append(pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends * np.int32(8)), pa.py_buffer(values)]))
    numbers = numbers.astype(np.int32) + (PARTS if table.column("space")[0].as_py() == "char" else 0)
    return pa.RecordBatch.from_arrays([pa.array(numbers), terms, *counts], names=["part", "terms", "df", "cf"])


def _numbers_in(cells: pa.ChunkedArray) -> pa.Array:
    return pa.array(np.concatenate([np.frombuffer(cell.as_buffer(), np.int64) for cell in cells]))


def _added_up(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    for space, mine in (("word", pc.less(table["part"], PARTS)), ("char", pc.greater_equal(table["part"], PARTS))):
        rows = table.filter(mine)
        if rows.num_rows:
            terms = pc.list_flatten(pc.split_pattern(rows["terms"], "\n"))
            flat = pa.table({"term": terms, "df": _numbers_in(rows["df"]), "cf": _numbers_in(rows["cf"])})
            sums = flat.group_by("term", use_threads=False).aggregate([("df", "sum"), ("cf", "sum")]).select(["term", "df_sum", "cf_sum"])
            sums = sums.rename_columns(["term", "df", "cf"])
            for batch in sums.to_batches(max_chunksize=BATCH_ENTRIES):
                yield _table(space, *batch.columns)


def _add_up_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by term. Rows come in the order of their parts; a part is added up when the next one begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").to_numpy()
        # The last part of a batch may go on in the next one.
        last = int(np.searchsorted(part, part[-1]))
        if held and held[-1].column("part")[0].as_py() != part[0] or last:
            yield from _added_up([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield from _added_up(held)


class _Sums:
    """Texts (df) and occurrences (cf) of numbered terms: those of each text are added up when many have come together."""

    def __init__(self) -> None:
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.keys, self.df, self.cf = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, keys: np.ndarray) -> None:
        self.new.append(_occurrences(keys))
        self.waiting += len(self.new[-1][0])
        if self.waiting >= 2 * MAX_LOCAL_TERMS:
            self.add_up()

    def add_up(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        df = np.concatenate([self.df, np.ones(self.waiting, np.int64)])
        cf = np.concatenate([self.cf, *(t for _, t in self.new)])
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.df, self.cf = (np.bincount(inverse, x, len(self.keys)).astype(np.int64) for x in (df, cf))
        self.new, self.waiting = [], 0

    def full(self) -> bool:
        return len(self.keys) >= MAX_LOCAL_TERMS


class _CharCounts:
    """Counts of the character n-grams that a task has met."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.alphabet, self.sums = Alphabet(), _Sums()

    def add(self, text: str) -> Iterator[pa.RecordBatch]:
        codes = code_points(text)
        if not self.alphabet.add(codes):
            yield self.table()
            self.clear()
            if not self.alphabet.add(codes):
                # A text of more characters than can be numbered: its n-grams are counted as they are.
                counts = Counter(g for w in text.split() for g in char_grams(w))
                yield _table("char", list(counts), np.ones(len(counts), np.int64), np.array(list(counts.values()), np.int64))
                return
        self.sums.add(gram_keys(codes, self.alphabet.of))
        if self.sums.full():
            yield self.table()
            self.clear()

    def table(self) -> pa.RecordBatch:
        self.sums.add_up()
        return _table("char", gram_strings(self.sums.keys, self.alphabet), self.sums.df, self.sums.cf)


class _Numbers(dict):
    """Numbers of tokens, given as they are met."""

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        return number


class _WordCounts:
    """Counts of the tokens and pairs of neighbouring tokens that a task has met."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known = _Numbers()
        self.sums = _Sums()

    def add(self, text: str) -> Iterator[pa.RecordBatch]:
        found = _TOKEN.findall(text)
        tokens = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        # Single tokens stand above all pairs, whose first number has 30 bits at most.
        self.sums.add(np.concatenate([tokens | 1 << 62, _pairs(tokens)]))
        if self.sums.full():
            yield self.table()
            self.clear()

    def table(self) -> pa.RecordBatch:
        self.sums.add_up()
        names, keys = pa.array(list(self.known), pa.string()), self.sums.keys
        # In the order of their numbers pairs come before single tokens.
        pairs = keys[keys < 1 << 62]
        joined = pc.binary_join_element_wise(names.take(pa.array(pairs >> 32)), names.take(pa.array(pairs & 0xFFFFFFFF)), " ")
        single = names.take(pa.array(keys[len(pairs) :] & ~(1 << 62)))
        return _table("word", pa.concat_arrays([joined, single]), self.sums.df, self.sums.cf)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spaces = [_WordCounts(), _CharCounts()]
    for batch in batches:
        for cell in batch.column("text"):
            text = cell.as_py()
            for counts in spaces:
                yield from counts.add(text)
    for counts in spaces:
        yield counts.table()


def _count_in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (_in_parts(table) for table in _count_terms(batches) if table.num_rows)


def dealt_out(rows: DataFrame) -> DataFrame:
    """Texts are dealt out by row where they come in fewer parts than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # With the number of parts given they stay as many; parts that are merged by size would leave cores idle.
    return rows.repartition(cores, "row_id") if rows.rdd.getNumPartitions() < cores else rows


def lowered_texts(rows: DataFrame) -> DataFrame:
    """Texts are lower-cased by Spark, as for the n-gram columns, and dealt out."""
    return dealt_out(rows.withColumn("text", F.lower(F.coalesce("text", F.lit("")))))


def term_counts(rows: DataFrame) -> DataFrame:
    """``(space, term, df, cf)`` over all texts: rows with a term and its occurrences. ``rows`` has ``row_id`` (a key) and ``text``.

    The terms that a task has met travel in one row for each part of their hashes, and a task adds up its parts one at a time.
    """
    counted = lowered_texts(rows.select("row_id", "text")).mapInArrow(_count_in_parts, "part int, terms string, df binary, cf binary")
    return counted.repartition("part").sortWithinPartitions("part").mapInArrow(_add_up_parts, "space string, term string, df bigint, cf bigint")


def vocabulary(
    terms: DataFrame, min_df: int = 2, word_features: int | None = WORD_FEATURES, char_features: int | None = CHAR_FEATURES
) -> DataFrame:
    """``(space, term, df, cf)``: terms of at least ``min_df`` texts, the most frequent ones per space.

    ``terms`` are counted already (``term_counts``) or long (``row_id, space, term, tf``). The limit keeps the largest corpus counts, ties by term.
    The count at which a space is full is found by counting; only terms with exactly that count are sorted.
    """
    if min_df < 1:
        raise ValueError("min_df must be positive.")
    counted = terms if "df" in terms.columns else terms.groupBy("space", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    counted = counted.where(F.col("df") >= min_df).select("space", "term", "df", "cf")
    limits = {space: n for space, n in (("word", word_features), ("char", char_features)) if n is not None}
    if not limits:
        return counted
    counted = materialize(counted, "counted-terms")
    kept = F.lit(True)
    edges = []
    # Few counts are distinct: a corpus of n terms has at most about the root of 2 n.
    sizes = materialize(counted.groupBy("space", "cf").agg(F.count("*").alias("n")), "counts-of-counts")
    for space, (cut, above) in nth_largest(sizes, "cf", limits, "space", "n").items():
        kept = kept & ((F.col("space") != space) | (F.col("cf") > cut))
        edge = counted.where((F.col("space") == space) & (F.col("cf") == cut))
        edges.append(first_rows(edge, limits[space] - above, [F.col("term")]))
    for space, limit in limits.items():
        if limit < 1:
            kept = kept & (F.col("space") != space)
    whole = counted.where(kept)
    for edge in edges:
        whole = whole.unionByName(edge)
    return whole


def with_index(vocab: DataFrame, n_docs: Column) -> DataFrame:
    """Adds ``idx`` (words first, then characters, by term) and ``idf``."""
    numbered = consecutive(with_idf(vocab, n_docs).select("space", "term", "idf"), "idx", [F.desc("space"), F.asc("term")])
    return numbered.select("space", "term", F.col("idx").cast("int").alias("idx"), "idf")


def with_idf(vocab: DataFrame, n_docs: Column) -> DataFrame:
    return vocab.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


# ---- sparse rows -----------------------------------------------------------------------------


class SentVocabulary(NamedTuple):
    """A vocabulary as the tasks get it: terms of both spaces, and ``idf`` by ``idx``."""

    terms: pa.Table
    idf: np.ndarray


def _found(keys: np.ndarray, idx: np.ndarray, asked: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the ``asked`` keys those in the sorted ``keys``: their ``idx``, and their ``times``."""
    if not len(keys):
        return asked[:0], times[:0]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    known = keys[at] == asked
    return idx[at[known]], times[known]


class TermTable:
    """A sent vocabulary as lookup tables, made once in each worker process."""

    _last: tuple[SentVocabulary, TermTable] | None = None

    def __init__(self, sent: SentVocabulary):
        self.idf = sent.idf
        by_idx = pa.array(np.argsort(sent.terms.column("idx").to_numpy()))
        #: Space and term by ``idx``.
        self.names = tuple(sent.terms.column(c).combine_chunks().take(by_idx) for c in ("space", "term"))
        spaces, terms, numbers = (sent.terms.column(c).to_pylist() for c in ("space", "term", "idx"))
        grams = {term: idx for space, term, idx in zip(spaces, terms, numbers, strict=True) if space == "char"}
        self.alphabet = Alphabet()
        # With too many characters to number them, n-grams are looked up one by one.
        self.grams = None if self.alphabet.add(code_points("".join(grams))) else grams
        keyed = sorted((self.alphabet.key(term), idx) for term, idx in grams.items()) if self.grams is None else []
        self.gram_keys, self.gram_idx = (np.array([x[n] for x in keyed], np.int64) for n in (0, 1))
        # Tokens of any term have numbers; a single token is found by its number, a pair in a sorted array.
        self.tokens: dict[str, int] = {}
        single: dict[int, int] = {}
        pairs: dict[int, int] = {}
        for space, term, idx in zip(spaces, terms, numbers, strict=True):
            if space == "word":
                parts = [self.tokens.setdefault(t, len(self.tokens)) for t in term.split(" ")]
                if len(parts) == 1:
                    single[parts[0]] = idx
                else:
                    pairs[parts[0] << 32 | parts[1]] = idx
        self.single = np.full(len(self.tokens) + 1, -1, np.int64)
        self.single[list(single)] = list(single.values())
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_idx = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    @classmethod
    def of(cls, sent: Broadcast[SentVocabulary]) -> TermTable:
        if cls._last is None or cls._last[0] is not sent.value:
            cls._last = (sent.value, cls(sent.value))
        return cls._last[1]

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Known tokens and pairs and how often each occurs."""
        found = _TOKEN.findall(text)
        tokens = np.fromiter(map(self.tokens.get, found, repeat(-1)), np.int64, len(found))
        pairs, times = _found(self.pair_keys, self.pair_idx, *_occurrences(_pairs(tokens)))
        singles, often = _occurrences(self.single[tokens])
        return np.concatenate([singles, pairs]), np.concatenate([often, times])

    def chars(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Known character n-grams and how often each occurs."""
        if self.grams is not None:
            counts = Counter(g for w in text.split() for g in char_grams(w) if g in self.grams)
            return np.array([self.grams[g] for g in counts], np.int64), np.array(list(counts.values()), np.int64)
        return _found(self.gram_keys, self.gram_idx, *_occurrences(gram_keys(code_points(text), self.alphabet.of)))

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indices in ascending order and weights (1 + ln tf) · idf, of unit length in each space."""
        parts = []
        for numbers, times in (self.words(text), self.chars(text)):
            weights = (1.0 + np.log(times)) * self.idf[numbers]
            if len(weights):
                weights /= np.sqrt(weights @ weights)
            parts.append((numbers, weights))
        indices, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(indices)
        return indices[order].astype(np.int32), values[order]

    def knows(self, text: str) -> bool:
        """Whether the text has a known term; one known token is enough, which nearly every text has."""
        if any(self.single[self.tokens.get(t, -1)] >= 0 for t in _TOKEN.findall(text)):
            return True
        return bool(len(self.chars(text)[0]) or len(self.words(text)[0]))


def send_vocabulary(vocab: DataFrame) -> Broadcast[SentVocabulary] | None:
    """The vocabulary (``space, term, idx, idf``) for the tasks; None if it is above the bound."""
    size = vocab.agg(F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).first()[0]
    if size > MAX_SENT_BYTES:
        return None
    terms = vocab.select("space", "term", "idx", "idf").toArrow()
    idf = np.zeros(terms.num_rows)
    idf[terms.column("idx").to_numpy()] = terms.column("idf").to_numpy()
    return vocab.sparkSession.sparkContext.broadcast(SentVocabulary(terms.drop_columns(["idf"]), idf))


def sparse_rows(rows: DataFrame, vocab: DataFrame, sent: Broadcast[SentVocabulary] | None = None) -> DataFrame:
    """``(row_id, indices, values)`` of each text with a known term: indices ascend, values are of unit length in each space.

    ``vocab`` has ``idx`` and ``idf``; ``sent`` saves sending it anew. Nothing is shuffled but, where they come in few parts, the texts.
    """
    sent = sent or send_vocabulary(vocab)
    if sent is None:
        return text_features(text_terms(rows), vocab)

    def lists(ids: pa.Array, part: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(i) for i, _ in part)], dtype=np.int32)
        cells = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in zip(*part, strict=True)]
        return pa.RecordBatch.from_arrays([ids, *cells], names=["row_id", "indices", "values"]).filter(pa.array(np.diff(ends) > 0))

    return _texts_as_rows(rows, sent, lists, "indices array<int>, values array<double>")


def _texts_as_rows(rows: DataFrame, sent: Broadcast[SentVocabulary], made: Callable, columns: str) -> DataFrame:
    """What ``made`` makes of the keys and the sparse rows of some texts: ``row_id`` and ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TermTable.of(sent)
        for batch in batches:
            low, size, part = 0, 0, []
            for n, text in enumerate(batch.column("text")):
                part.append(table.row(text.as_py()))
                size += len(part[-1][0])
                if size >= BATCH_ENTRIES or n + 1 == batch.num_rows:
                    yield made(batch.column("row_id").slice(low, len(part)), part)
                    low, size, part = n + 1, 0, []

    row_type = rows.schema["row_id"].dataType.simpleString()
    return lowered_texts(rows.select("row_id", "text")).mapInArrow(run, f"row_id {row_type}, {columns}")


def counted_rows(rows: DataFrame, vocab: DataFrame, sent: Broadcast[SentVocabulary] | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """``(row_id, kept columns, n_words, indices, times)`` of each text with a known term: what ``sparse_rows`` makes its values of, in a tenth of the space.

    ``indices`` are the differences of the ascending indices and ``times`` the occurrences, both as 32-bit numbers in bytes; the first ``n_words``
    are words. ``weighted_rows`` reads them.
    """
    sent = sent or send_vocabulary(vocab)
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("row_id", *kept))

    def packed(entries: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[list[pa.Array], pa.Array]:
        found = [(n, np.diff(i, prepend=0).astype(np.int32).tobytes(), t.astype(np.int32).tobytes()) for n, i, t in entries]
        columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]
        return columns, pa.array([len(i) > 0 for _, i, _ in found], pa.bool_())

    def of_text(table: TermTable, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        spaces = []
        for numbers, times in (table.words(text), table.chars(text)):
            order = np.argsort(numbers)
            spaces.append((numbers[order], times[order]))
        return len(spaces[0][0]), *(np.concatenate(x) for x in zip(*spaces, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TermTable.of(sent)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                columns, known = packed(of_text(table, text.as_py()) for text in part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row_id", *kept)), *columns], names=["row_id", *kept, "n_words", "indices", "times"]).filter(known)

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = ((n, e.values.field("idx").to_numpy(), e.values.field("tf").to_numpy()) for n, e in zip(part.column("n_words").to_pylist(), part.column("es"), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row_id", *kept)), *packed(lists)[0]], names=["row_id", *kept, "n_words", "indices", "times"])

    schema = f"{types}, n_words int, indices binary, times binary"
    if sent is not None:
        return lowered_texts(rows.select("row_id", "text", *kept)).mapInArrow(run, schema)
    known = text_terms(rows).join(vocab.select("space", "term", "idx"), ["space", "term"])
    lists = known.groupBy("row_id").agg(F.count_if(F.col("space") == "word").cast("int").alias("n_words"), F.array_sort(F.collect_list(F.struct("idx", "tf"))).alias("es"))
    return rows.select("row_id", *kept).join(lists, "row_id").mapInArrow(regroup, schema)


class WeightedRows(NamedTuple):
    """Rows of a sparse matrix as ``sparse_rows`` has them: row i begins at starts[i]; no row is empty."""

    starts: np.ndarray
    sizes: np.ndarray
    indices: np.ndarray
    values: np.ndarray


def _numbers(cells: pa.BinaryArray) -> np.ndarray:
    """The 32-bit numbers of all cells, as they lie in one buffer."""
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(cells.buffers()[2], np.int32, (int(ends[-1]) - int(ends[0])) // 4, int(ends[0]))


def weighted_rows(batch: pa.RecordBatch, idf: np.ndarray) -> WeightedRows:
    """The rows of a batch of ``counted_rows`` with their weights (1 + ln tf) · idf, of unit length in each space."""
    sizes = pc.binary_length(batch.column("indices")).to_numpy().astype(np.int64) // 4
    starts = np.cumsum(sizes) - sizes
    indices = np.cumsum(_numbers(batch.column("indices")), dtype=np.int64)
    indices -= np.repeat(np.concatenate([[0], indices[starts[1:] - 1]]), sizes)
    times = _numbers(batch.column("times"))
    values = (1.0 + np.log(np.arange(1, int(times.max()) + 1))).take(times - 1) if times.max() < 1 << 16 else 1.0 + np.log(times)
    values *= idf.take(indices)
    # Words of a row stand before its characters.
    words = batch.column("n_words").to_numpy().astype(np.int64)
    parts = np.stack([words, sizes - words], 1).ravel()
    at = (np.cumsum(parts) - parts)[parts > 0]
    values /= np.repeat(np.sqrt(np.add.reduceat(values * values, at)), parts[parts > 0])
    return WeightedRows(starts, sizes, indices, values)


def rows_with_terms(rows: DataFrame, vocab: DataFrame, sent: Broadcast[SentVocabulary] | None = None) -> DataFrame:
    """``row_id`` of the texts with a known term."""
    sent = sent or send_vocabulary(vocab)
    if sent is None:
        return text_terms(rows).join(vocab.select("space", "term"), ["space", "term"], "left_semi").select("row_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TermTable.of(sent)
        for batch in batches:
            known = pa.array([table.knows(text.as_py()) for text in batch.column("text")], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("row_id").filter(known)], names=["row_id"])

    row_type = rows.schema["row_id"].dataType.simpleString()
    return lowered_texts(rows.select("row_id", "text")).mapInArrow(run, f"row_id {row_type}")


def tfidf(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(row_id, space, term, weight)``: (1 + ln tf) · idf, unit length per row and space. ``vocab`` has ``idx`` and ``idf``."""
    sent = send_vocabulary(vocab)
    if sent is None:
        entries = F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("weight"))
        long = text_features(text_terms(rows), vocab).select("row_id", F.explode(entries).alias("e")).select("row_id", "e.idx", "e.weight")
        return long.join(vocab.select("idx", "space", "term"), "idx").select("row_id", "space", "term", "weight")

    def named(ids: pa.Array, part: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        # A task that was sent the vocabulary names the terms itself.
        indices, values = (np.concatenate(x) for x in zip(*part, strict=True))
        row, at = np.repeat(np.arange(len(part)), [len(i) for i, _ in part]), pa.array(indices)
        spaces, terms = TermTable.of(sent).names
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), spaces.take(at), terms.take(at), pa.array(values)], names=["row_id", "space", "term", "weight"])

    return _texts_as_rows(rows, sent, named, "space string, term string, weight double")


def text_features(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """As ``sparse_rows`` from a long table of terms, for a vocabulary that is too large to be sent: one join by term, one regrouping by row."""
    raw = terms.join(vocab.select("space", "term", "idx", "idf"), ["space", "term"])
    weight = (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    entries = raw.select("row_id", F.struct(F.col("idx"), weight.alias("w")).alias("e"), (F.col("space") == "word").alias("_is_word"))
    square = F.col("e.w") * F.col("e.w")
    gathered = entries.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("e.idx").alias("idx"), F.col("e.w").alias("w"), F.col("_is_word")))).alias("es"),
        F.sqrt(F.sum(F.when(F.col("_is_word"), square))).alias("word_norm"),
        F.sqrt(F.sum(F.when(~F.col("_is_word"), square))).alias("char_norm"),
    )
    unit = F.transform("es", lambda e: e["w"] / F.when(e["_is_word"], F.col("word_norm")).otherwise(F.col("char_norm")))
    return gathered.select("row_id", F.transform("es", lambda e: e["idx"]).alias("indices"), unit.alias("values"))


def multi_hot(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Positive cells ``(row_id, code, label=1)`` of the target matrix; codes outside the classes are ignored."""
    long = rows.select("row_id", F.explode(F.array_distinct("codes")).alias("code"))
    return long.join(classes.select("code"), "code", "left_semi").select("row_id", "code", F.lit(1).alias("label"))
