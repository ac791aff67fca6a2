"""Sub-word vocabularies (V1) and longest-match encoding.

A word is cut into pieces: the first one as it is written, the others with
``##`` in front.  Two ways to learn the pieces:

- ``learn_subwords``: merges of neighbouring pieces, most frequent pair first
  (ties by the pieces), until the vocabulary has its size;
- ``vocab_substrings``: the most frequent substrings of the words.

Merging in rounds is exact.  Take a count t, and call a pair *hot* if it occurs t times or more.  A pair
that a merge makes is never more frequent than the pairs it was made of, so all
merges down to t happen inside of runs of symbols whose neighbours are all hot.
One round therefore counts the distinct hot runs of the words (few, as few pairs are hot), merges
them on the driver one by one, in the one and only order, until no pair occurs t times, and applies
the merges to the words that have such runs.  Words say which pairs they lost and got, so the
pair counts are kept up by differences, and words that are one piece drop out.  Rounds take more pairs
as the runs become few: their number follows the size of the vocabulary, not that of the input.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import explode_rows
from ..session import bound_batches, checkpoint
from .encode import SHIPPED, chars, lower_tokens, top_k_by_count
from .order import row_index

#: Longer words are not learned from and are unknown to the encoder.
MAX_WORD = 100
#: The first round takes the pairs that are as frequent as the one of this rank, later ones twice as many while their runs are few.
ROUND_PAIRS = 1_000
#: Distinct hot runs that may reach the driver; a round that has more takes fewer pairs.
MAX_RUNS = 300_000


def distinct_words(df: DataFrame, text: str) -> DataFrame:
    """Lower-cased words of at most ``MAX_WORD`` characters with their counts: (word, n)."""
    words = explode_rows(df.select(lower_tokens(text).alias("_t")), "_t", "word", keep=[])
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.length("word").between(1, MAX_WORD))


def _pairs(symbols: list[str]):
    return zip(symbols, symbols[1:], strict=False)


class HotPairs:
    """Pairs of symbols as whole numbers: the places of both among all symbols of hot pairs."""

    def __init__(self, pairs):
        names = sorted({s for p in pairs for s in p})
        at = {s: i for i, s in enumerate(names)}
        self.names = pa.array(names, pa.string())
        self.codes = np.array(sorted(at[a] * len(names) + at[b] for a, b in pairs), np.int64)

    def spans(self, symbols: pa.Array):
        """Places of the symbols of a column of words among the names (-1: none), and the maximal runs of symbols
        whose neighbours are hot: first symbols, ends, and words."""
        flat = symbols.flatten()
        at = pc.fill_null(pc.index_in(flat, value_set=self.names.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(symbols).to_numpy(zero_copy_only=False))
        pair = np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1] * len(self.names) + at[1:], -1)
        pair[ends[:-1] - 1] = -1  # not over the end of a word
        place = np.minimum(np.searchsorted(self.codes, pair), len(self.codes) - 1)
        edge = np.flatnonzero(np.diff(self.codes[place] == pair, prepend=False, append=False))
        return at.astype(np.int32), edge[::2], edge[1::2] + 1, np.searchsorted(ends, edge[::2], side="right")


def _hot_runs(hot: HotPairs):
    """Maximal runs of symbols whose neighbours are hot pairs, as places among the names."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, begins, ends, words = hot.spans(batch.column("symbols"))
            found: dict[bytes, int] = defaultdict(int)
            for i, j, n in zip(begins.tolist(), ends.tolist(), batch.column("n").to_numpy()[words].tolist(), strict=True):
                found[at[i:j].tobytes()] += n
            sizes = [0, *(len(k) // 4 for k in found)]
            runs = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([runs, pa.array(list(found.values()), pa.int64())], ["run", "n"])

    return run


def join_symbols(a: str, b: str) -> str:
    return a + b.removeprefix("##")


def _merge(symbols: list[str], a: str, b: str) -> list[str]:
    out, i = [], 0
    while i < len(symbols):
        if symbols[i] == a and i + 1 < len(symbols) and symbols[i + 1] == b:
            out.append(join_symbols(a, b))
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def merge_runs(runs: list[tuple[list[str], int]], least: int, room: int, known: set[str]) -> list[tuple[str, str, int]]:
    """Merge runs one pair at a time while one occurs ``least`` times and ``room`` new symbols are left; returns (a, b, n)."""
    runs = [list(r) for r in runs]
    counts: dict[tuple, int] = defaultdict(int)
    where: dict[tuple, set[int]] = defaultdict(set)
    for i, (symbols, n) in enumerate(runs):
        for p in _pairs(symbols):
            counts[p] += n
            where[p].add(i)
    heap = [(-n, *p) for p, n in counts.items() if n >= least]
    heapq.heapify(heap)
    merges = []
    while heap and room > 0:
        n, a, b = heapq.heappop(heap)
        if counts.get((a, b), 0) != -n:
            continue  # an older count
        merges.append((a, b, -n))
        if join_symbols(a, b) not in known:
            known.add(join_symbols(a, b))
            room -= 1
        changed = set()
        for i in where.pop((a, b)):
            symbols, k = runs[i]
            new = _merge(symbols, a, b)
            for p in _pairs(symbols):
                counts[p] -= k
                changed.add(p)
            for p in _pairs(new):
                counts[p] += k
                where[p].add(i)
                changed.add(p)
            runs[i][0] = new
        counts.pop((a, b), None)
        for p in changed:
            if counts.get(p, 0) >= least:
                heapq.heappush(heap, (-counts[p], *p))
    return merges


def _merged(symbols: list[str], rank: dict) -> list[str]:
    """Symbols with the merges applied in their order."""
    while True:
        r, a, b = min(((rank[p], *p) for p in _pairs(symbols) if p in rank), default=(None, "", ""))
        if r is None:
            return symbols
        symbols = _merge(symbols, a, b)


def _apply(merges: list[tuple], hot: HotPairs):
    """Words with the merges applied in their order, and rows (a, b, n): what the pairs of a batch lost and got.

    Merges happen inside of hot runs; a task merges each distinct run once, and words without one pass through.
    """
    rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
    names = ["symbols", "a", "b", "n"]

    def words_of(symbols, n):
        return pa.RecordBatch.from_arrays([symbols, pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.string()), n], names)

    def run(batches):
        done: dict[bytes, list | None] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols, n = batch.column("symbols"), batch.column("n")
            at, begins, ends, words = hot.spans(symbols)
            offsets = np.cumsum(pc.list_value_length(symbols).to_numpy(zero_copy_only=False))
            new: dict[int, list] = {}  # per word its changed runs, from left to right
            for i, j, w in zip(begins.tolist(), ends.tolist(), words.tolist(), strict=True):
                key = at[i:j].tobytes()
                if key not in done:
                    old = hot.names.take(pa.array(at[i:j])).to_pylist()
                    got = _merged(old, rank)
                    done[key] = got if len(got) < len(old) else None
                if done[key] is not None:
                    new.setdefault(w, []).append((i, j, done[key]))
            touched = np.zeros(batch.num_rows, bool)
            touched[list(new)] = True
            yield words_of(symbols.filter(pa.array(~touched)), n.filter(pa.array(~touched)))
            if not new:
                continue
            change: dict[tuple, int] = defaultdict(int)
            out, changed = [], n.filter(pa.array(touched))
            for w, old, k in zip(np.flatnonzero(touched).tolist(), symbols.filter(pa.array(touched)).to_pylist(), changed.to_pylist(), strict=True):
                first, word, last = int(offsets[w]) - len(old), [], 0
                for i, j, got in new[w]:
                    word += old[last : i - first]
                    word += got
                    last = j - first
                word += old[last:]
                for p in _pairs(old):
                    change[p] -= k
                for p in _pairs(word):
                    change[p] += k
                out.append(word)
            yield words_of(pa.array(out, symbols.type), changed)
            change = {p: d for p, d in change.items() if d}
            pairs = [pa.array([p[i] for p in change], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(change), symbols.type), *pairs, pa.array(list(change.values()), pa.int64())], names)

    return run


def learn_subwords(df: DataFrame, text: str, size: int, least: int = 2, pairs_per_round: int = ROUND_PAIRS) -> DataFrame:
    """V1(b): a vocabulary of ``size`` entries, the special ones included -> (token, id).

    First the single characters (by count, then by themselves), then the merges in their
    order, until the size is reached or no pair occurs ``least`` times.
    ``merges_of`` also returns the merges.
    """
    return merges_of(df, text, size, least, pairs_per_round)[0]


def merges_of(df: DataFrame, text: str, size: int, least: int = 2, pairs_per_round: int = ROUND_PAIRS) -> tuple[DataFrame, list[tuple], int]:
    """(vocabulary, merges as (a, b, n), rounds)."""
    spark = df.sparkSession
    symbols = F.transform(chars(F.col("word")), lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit("##"), c)))
    words = checkpoint(distinct_words(df, text).select(symbols.alias("symbols"), "n"))
    letters = words.select(F.explode("symbols").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    # at most ``size`` rows, a parameter
    letters = [r["token"] for r in letters.orderBy(F.col("n").desc(), "token").limit(max(0, size - len(K.SPECIAL_TOKENS))).collect()]
    room = size - len(K.SPECIAL_TOKENS) - len(letters)
    words = words.where(F.size("symbols") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("symbols") - 2), lambda i: F.struct(F.get("symbols", i).alias("a"), F.get("symbols", i + 1).alias("b")))
    counts = checkpoint(words.select(F.explode(pairs).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n")))

    merges: list[tuple] = []
    known: set[str] = set(letters)
    rounds, wanted = 0, pairs_per_round
    while room > 0:
        top = counts.where(F.col("n") >= least).orderBy(F.col("n").desc()).limit(wanted).select("n").collect()
        if not top:
            break
        rounds += 1
        level, whole = top[-1]["n"], True
        while True:  # fewer pairs where their runs would be too many
            got = counts.where(F.col("n") >= level).select("a", "b").toArrow()
            hot = HotPairs(list(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True)))
            found_runs = words.mapInArrow(_hot_runs(hot), "run array<int>, n long").groupBy("run").agg(F.sum("n").alias("n"))
            runs = found_runs.limit(MAX_RUNS + 1).toArrow()
            if runs.num_rows <= MAX_RUNS or level >= top[0]["n"]:
                break
            whole = False
            level = top[len(top) // 4]["n"] if top[len(top) // 4]["n"] > level else top[0]["n"]
            top = [t for t in top if t["n"] >= level]
        if runs.num_rows > MAX_RUNS:
            runs = found_runs.toArrow()
        # few runs: the next round takes more pairs, as every round reads all words
        wanted = max(pairs_per_round, wanted // 4) if not whole else wanted * 2 if runs.num_rows <= MAX_RUNS // 8 else wanted
        names = hot.names.to_pylist()
        found = merge_runs([([names[i] for i in r], n) for r, n in zip(runs.column("run").to_pylist(), runs.column("n").to_pylist(), strict=True)], level, room, known)
        room = size - len(K.SPECIAL_TOKENS) - len(known)
        merges += found
        if room <= 0:
            break
        done = checkpoint(words.mapInArrow(_apply(found, hot), "symbols array<string>, a string, b string, n long"))
        change = done.where(F.col("a").isNotNull()).select("a", "b", "n")
        counts = checkpoint(counts.unionByName(change).groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") > 0))
        words = done.where(F.col("a").isNull() & (F.size("symbols") > 1)).select("symbols", "n")
    tokens = list(dict.fromkeys([*K.SPECIAL_TOKENS, *letters, *(join_symbols(a, b) for a, b, _ in merges)]))[:size]
    return spark.createDataFrame(list(zip(tokens, range(len(tokens)), strict=True)), "token string, id int"), merges, rounds


def vocab_substrings(df: DataFrame, text: str, k: int, longest: int = 6) -> DataFrame:
    """V1(c): the ``k`` most frequent pieces (substrings of up to ``longest`` characters) of the words -> (token, id, n).

    Ids follow count (falling) and token, after the special ones.
    """
    words = distinct_words(df, text)
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    cuts = words.select("word", "n", at).select("word", "n", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("at") + 1))).alias("size"))
    token = F.concat(F.when(F.col("at") == 1, F.lit("")).otherwise(F.lit("##")), F.substr("word", F.col("at"), F.col("size")))
    counts = checkpoint(cuts.select(token.alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n")))
    top = top_k_by_count(counts, k, "token", "n").withColumn("_less", -F.col("n"))
    return row_index(top, ["_less", "token"], "_i").select("token", (F.col("_i") + len(K.SPECIAL_TOKENS)).cast("int").alias("id"), "n")


class Trie:
    """Longest match over a vocabulary: nested dicts by character, the id of an entry under ''."""

    def __init__(self, tokens: list[str], ids: list[int]):
        self.first: dict = {}
        self.inside: dict = {}
        for t, i in zip(tokens, ids, strict=True):
            inside = t.startswith("##") and len(t) > 2
            node = self.inside if inside else self.first
            for c in t[2:] if inside else t:
                node = node.setdefault(c, {})
            node[""] = i

    def match(self, word: str) -> list[int]:
        """Ids of the longest pieces from left to right; the unknown id alone where a rest has none."""
        if len(word) > MAX_WORD:
            return [K.UNK_ID]
        out, at, node = [], 0, self.first
        while at < len(word):
            best, end = None, at
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if "" in node:
                    best, end = node[""], i + 1
            if best is None:
                return [K.UNK_ID]
            out.append(best)
            at, node = end, self.inside
        return out


def subword_ids(df: DataFrame, tokens: str, vocab: DataFrame, out: str = "pieces") -> DataFrame:
    """V2: word array -> array of the piece ids of every word (``array<array<int>>``).

    The vocabulary, of at most ``SHIPPED`` rows, is shipped to the tasks as two Arrow arrays;
    every task builds one trie.  A batch looks up its distinct words once each.
    """
    rows = vocab.select("token", F.col("id").cast("int").alias("id")).limit(SHIPPED + 1).toArrow()
    if rows.num_rows > SHIPPED:
        raise ValueError(f"a sub-word vocabulary has at most {SHIPPED} rows")
    bound_batches(df.sparkSession)
    bc = df.sparkSession.sparkContext.broadcast((rows.column("token").combine_chunks(), rows.column("id").combine_chunks()))
    held: dict = {}

    @F.arrow_udf("array<array<int>>")
    def _encode(col: pa.Array) -> pa.Array:
        if "trie" not in held:
            held["trie"] = Trie(*(c.to_pylist() for c in bc.value))
        words = col.flatten().dictionary_encode()
        found = [held["trie"].match(w) for w in words.dictionary.to_pylist()]
        per_word = pa.array(found, pa.list_(pa.int32())).take(words.indices)
        sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))
        return pa.ListArray.from_arrays(ends, per_word, mask=col.is_null()) if col.null_count else pa.ListArray.from_arrays(ends, per_word)

    return df.withColumn(out, _encode(F.col(tokens)))


def encode_subwords(df: DataFrame, tokens: str, vocab: DataFrame, out: str = "input_ids", add_special: bool = True) -> DataFrame:
    """V2: word array -> one id array of its pieces; optional [CLS] ... [SEP]."""
    body = F.flatten("_pieces")
    ids = F.concat(F.array(F.lit(K.CLS_ID)), body, F.array(F.lit(K.SEP_ID))) if add_special else body
    return subword_ids(df, tokens, vocab, "_pieces").withColumn(out, ids).drop("_pieces")


def subword_table(pieces: Column, max_length: int) -> Column:
    """Pieces of ``subword_ids`` as structs (piece, word index, index within the word), with room for [CLS]/[SEP]."""
    per_word = F.transform(pieces, lambda ps, i: F.transform(ps, lambda p, j: F.struct(p.alias("piece"), i.alias("word"), j.alias("sub"))))
    return F.slice(F.flatten(per_word), 1, max_length - 2)
