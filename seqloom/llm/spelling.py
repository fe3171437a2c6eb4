"""Groups of spelling variants: words one edit apart, found through an index of variable-length grams.

Words are counted over all texts. The gram dictionary is a trie in a table: every start
of a word has its five-letter gram, a gram's prefixes are counted over the words, and the
shortest prefix that at most MAX_LIST starts share (else all five letters) is the gram of
that start: frequent short grams are pruned in favour of longer ones. A word is then the
set of its grams with their starts. An edit affects only grams that cover it; the bound
of a word on a set of its grams is the largest number that one position is covered by.
The rarest grams of a word, as many as exceed their own bound, are its lists in the
index: two words one edit apart share one of the unaffected ones, and the rarest of those
lies in both sets, at the same distance from the start or from the end. Lists are merged
in blocks and every pair is verified letter by letter; only links leave a task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import drop_written, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TYPO_MODULUS = 97  # a run whose checksum it divides loses a letter
MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2  # a form occurs so many times as often as the word

LEAST_GRAM, MOST_GRAM = 2, 5
MAX_LIST = 48  # starts that share a gram before it is pruned for a longer one
BLOCK = 256  # words of a list held against as many others
HELD_WORDS = 200_000  # distinct words counted in a task before they are passed on; only speed depends on it
_PAIRS = 1 << 18  # pairs verified at once
_WIDE = 48  # longer words are compared one by one


def edited(run: str, doc_id: int | None) -> str:
    """The word of a lower-cased run: without one letter if the checksum of '<doc_id>:<run>' says so. A null id is an empty string."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % TYPO_MODULUS else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    names = ["word", "n"]
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if not text.is_valid:
                continue
            prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            runs = Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode()))  # bytes.lower() changes A-Z alone
            for run, n in runs.items():
                if len(run) >= MIN_LETTERS:
                    h = zlib.crc32(run.encode(), prefix)
                    if h % TYPO_MODULUS:
                        seen[run] += n
                    elif len(run) > MIN_LETTERS:
                        at = h % len(run)
                        seen[run[:at] + run[at + 1 :]] += n
            if len(seen) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names)
                seen = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names)


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with enough letters and occurrences; each distinct run of a text is looked at once."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def gram_starts(words: DataFrame) -> DataFrame:
    """(word, n, start, gram): MOST_GRAM letters from each start; a word has one mark before it, and marks after it fill the grams."""
    padded = F.concat(F.lit("^"), "word", F.lit("$" * (MOST_GRAM - LEAST_GRAM + 1)))
    starts = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda p: F.substring(F.col("padded"), p, F.lit(MOST_GRAM))))
    return words.select("word", "n", padded.alias("padded")).select("word", "n", starts.alias("start", "gram"))


def gram_dictionary(starts: DataFrame, max_list: int = MAX_LIST) -> tuple[DataFrame, DataFrame]:
    """(gram, length, count) and the counts it comes from: the length to which each longest gram is pruned, and how many starts share that prefix."""
    full = written(starts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    out = full.select("gram", F.lit(MOST_GRAM).alias("length"), F.col("n").alias("count"))
    for q in range(MOST_GRAM - 1, LEAST_GRAM - 1, -1):
        own = F.substring("gram", 1, q)
        shared = full.groupBy(own.alias("prefix")).agg(F.sum("n").alias("shared")).where(F.col("shared") <= max_list)  # the frequent ones stay longer
        out = out.withColumn("prefix", own).join(shared, "prefix", "left")
        out = out.select("gram", F.when(F.col("shared").isNotNull(), q).otherwise(F.col("length")).alias("length"), F.coalesce("shared", "count").alias("count"))
    return written(out, "dictionary"), full


def index_grams(word: str, grams: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The word's lists in the index, of its grams (start, gram, count).

    The rarest distinct grams with all their starts, ties by the gram itself, until they are more than their
    own bound of affected grams: the most of them that cover one position.
    """
    width = len(word) + 2
    order = sorted(grams, key=lambda g: (g[2], g[1], g[0]))
    covered, bound = [0] * width, 0
    for k, (start, gram, _) in enumerate(order, 1):
        for at in range(start, min(start + len(gram), width)):
            covered[at] += 1
            bound = max(bound, covered[at])
        if k > bound and (k == len(order) or order[k][1] != gram):
            return order[:k]
    return order


def index_keys(word: str, grams: list[tuple[int, str, int]]) -> list[int]:
    """Hashes of (gram, distance from the start) and (gram, distance from the end): an unaffected gram keeps one of them."""
    width, keys = len(word) + 2, set()
    for start, gram, _ in index_grams(word, grams):
        keys |= {xxhash.xxh3_64_intdigest(f"{gram}{start}") - (1 << 63), xxhash.xxh3_64_intdigest(f"{gram}{start - width}") - (1 << 63)}
    return list(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            some = batch.slice(at, 4096)
            keys = [index_keys(w, [(g["start"], g["gram"], g["count"]) for g in gs]) for w, gs in zip(some.column(0).to_pylist(), some.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(keys, pa.list_(pa.int64()))], ["word", "n", "keys"])


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = len(os.path.commonprefix([a, b]))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def near_pairs(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (words[i], words[j]) are one edit apart: common beginning and end leave one letter at most."""
    size = np.array([len(w) for w in words])
    use = np.flatnonzero(np.abs(size[i] - size[j]) <= 1)
    out = np.zeros(len(i), bool)
    wide = np.maximum(size[i[use]], size[j[use]]) > _WIDE
    for k in use[wide].tolist():
        out[k] = one_edit(words[i[k]], words[j[k]])
    use = use[~wide]
    if not len(use):
        return out
    width = int(min(size.max(), _WIDE))
    short = [w.encode("latin-1")[:width] for w in words]
    left = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in short), np.uint8).reshape(-1, width)
    right = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in short), np.uint8).reshape(-1, width)
    for at in range(0, len(use), _PAIRS):
        k = use[at : at + _PAIRS]
        a, b = i[k], j[k]
        least = np.minimum(size[a], size[b])
        begin, end = (np.minimum(np.where((differ := x[a] != x[b]).any(1), differ.argmax(1), width), least) for x in (left, right))
        out[k] = (begin < np.maximum(size[a], size[b])) & (begin + end >= np.maximum(size[a], size[b]) - 1)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (word, other, other_n), both ways, of blocks (x, y); a null y stands for x itself."""
    for batch in batches:
        words: list[str] = []
        counts: list[int] = []
        left, right, held = [], [], 0

        def flush() -> pa.RecordBatch | None:
            nonlocal words, counts, left, right, held
            i, j = np.concatenate(left), np.concatenate(right)
            near = near_pairs(words, i, j)
            i, j = i[near].tolist(), j[near].tolist()
            found = set(zip((words[k] for k in i + j), (words[k] for k in j + i), (counts[k] for k in j + i)))
            words, counts, left, right, held = [], [], [], [], 0
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.int64()))], ["word", "other", "other_n"])

        for x, y in zip(batch.column(0), batch.column(1)):
            at = len(words)
            words += x.values.field("word").to_pylist()
            counts += x.values.field("n").to_pylist()
            middle = len(words)
            if y.is_valid:
                words += y.values.field("word").to_pylist()
                counts += y.values.field("n").to_pylist()
                i, j = np.meshgrid(np.arange(at, middle), np.arange(middle, len(words)), indexing="ij")
                i, j = i.reshape(-1), j.reshape(-1)
            else:
                i, j = np.triu_indices(middle - at, 1)
                i, j = i + at, j + at
            left.append(i)
            right.append(j)
            held += len(i)
            if held >= _PAIRS:
                if (out := flush()) is not None:
                    yield out
        if left and (out := flush()) is not None:
            yield out


def links(words: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """(word, other, other_n) for every pair of words one edit apart, both ways, written; words has (word, n), each word once.

    A list of the index that is longer than BLOCK is dealt to blocks by hash, and a row of the join is a
    pair of blocks: (list, block) is the key, so even one list with a third of all words spreads over tasks.
    """
    starts = gram_starts(words)
    dictionary, full = gram_dictionary(starts, max_list)
    grams = starts.join(dictionary, "gram").select("word", "n", F.struct("start", F.expr("substring(gram, 1, length)").alias("gram"), "count").alias("g"))
    split = grams.groupBy("word", "n").agg(F.collect_list("g").alias("grams"))  # at most a word's letters
    keyed = written(split.mapInArrow(_keyed, "word string, n bigint, keys array<bigint>").select("word", "n", F.explode("keys").alias("key")), "index")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    listed = keyed.join(sizes, "key").withColumn("blocks", F.expr(f"cast(ceil(size / {BLOCK}) as bigint)"))
    listed = listed.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    blocks = written(listed.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("word", "n")).alias("rows")), "blocks")  # about BLOCK words
    shape = blocks.schema["rows"].dataType.simpleString()
    alone = blocks.where(F.size("rows") > 1).select(F.col("rows").alias("x"), F.lit(None).cast(shape).alias("y"))
    asking = blocks.where("block + 1 < blocks").select("key", F.explode(F.expr("sequence(block + 1, blocks - 1)")).alias("block"), F.col("rows").alias("x"))
    across = asking.join(blocks.where("blocks > 1").select("key", "block", F.col("rows").alias("y")), ["key", "block"]).select("x", "y")
    found = alone.unionByName(across).mapInArrow(_links, "word string, other string, other_n bigint").distinct()
    found = written(found, "word-links")
    drop_written(dictionary, full, keyed, blocks)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form): the last word that forms lead to, by pointer doubling.

    A form occurs at least RATIO times as often as its word, so chains are short and have no ring.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_written(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """A row per word of the documents (doc_id, text): word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with only A-Z lower-cased, some of them
    without a letter (see edited()), of MIN_LETTERS letters and MIN_COUNT occurrences over all
    rows. n_near counts the words one edit apart, form is the most frequent of them (ties: the
    smallest in code-point order) if it occurs RATIO times as often, root the last word that
    forms lead to. Null and empty texts hold no words; repeated rows count each; a null doc_id
    is an empty string in the checksum; a word may be of any length; an empty table gives
    no row; other columns are ignored.
    """
    words = written(words_of(docs), "words")
    found = links(words)
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("o"))).alias("b")  # strings compare in code-point order
    near = found.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.o").alias("best"))
    named = words.join(near, "word", "left")
    good = F.col("best_n") >= RATIO * F.col("n")
    named = written(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    led = roots(named.where("form is not null").select("word", "form"))
    out = named.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = written(out, "variants")
    drop_written(words, found, named, led)
    return out


#: The same for a table `documents` in SQL: crc32 by its table of 256 remainders, near words by deleted letters.
SQL = r"""
with recursive t(i, k, c) as (select i, 0, i from range(256) as u(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from t where k < 8),
crc as (select list(c order by i) as tab from t where k = 8),
runs as (select coalesce(cast(doc_id as varchar), '') as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
each as (select d, run, count(*) as n, hex(encode(d || ':' || run)) as x from runs group by d, run having length(run) >= 5),
h as (select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) as h from each, crc),
e as (select case when h % 97 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from h),
w as (select word, cast(sum(n) as bigint) as n from e where length(word) >= 5 group by word having sum(n) >= 3),
del as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as v from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
near as (select a.word, b.word as other, b.n as other_n from del a join del b on a.v = b.v and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from del a join w b on a.v = b.word union select b.word, a.word, a.n from del a join w b on a.v = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n from w left join best on best.word = w.word),
chain(word, reached, step) as (select word, word, 0 from f union all select chain.word, f.form, step + 1 from chain join f on f.word = chain.reached where f.form is not null),
root as (select word, arg_max(reached, step) as root from chain group by word)
select f.word, form, root, n, n_near, form_n from f join root on root.word = f.word
"""
