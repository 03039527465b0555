"""Words that are one edit apart, found by search schemes over a bidirectional FM-index."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgemart.llm.scratch import map_arrow, map_pandas, saved, slices, texts_as_bytes, whole_number

RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 18
#: Words of a cell that one index holds at most, and characters of the cells that share an index.
PIECE, SHARD = 1 << 14, 1 << 18
ASKED = 1 << 13  # words, in all their cells, for each task
STEP = 32  # symbols between stored ranks


def vocabulary(
    docs: DataFrame, typo_every: int = 199, least_chars: int = 6, least_count: int = 5, *,
    doc_id="doc_id", text="text",
) -> DataFrame:
    """(word, n) of the words of all texts: maximal runs of letters, A-Z lower-cased. Where
    `typo_every` divides the crc32 h of `<doc_id>:<run>`, the run's character h % length is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            words = [w for w in counts if len(w) >= least_chars]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for rows in slices([batch], "text"):
                for doc, data in zip(rows.column("doc_id").to_pylist(), texts_as_bytes(rows, "text"), strict=True):
                    start = zlib.crc32(f"{doc or ''}:".encode())
                    for word, n in Counter(RUN.findall(data.lower().decode())).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield told()
                    counts.clear()
        yield told()

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    counted = map_arrow(rows, run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Index:
    """FM-index of a cyclic sequence of symbols, no two rotations of which are equal."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        while True:
            key = rank * (max(n, symbols) + 1) + np.roll(rank, -reach)
            self.rotations = np.argsort(key, kind="stable")
            ordered = key[self.rotations]
            place = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[self.rotations] = place
            if place[-1] == n - 1:
                break
            reach *= 2
        self.last = text[self.rotations - 1]
        self.blocks = np.concatenate((self.last, np.full(STEP - n % STEP, symbols, self.last.dtype))).reshape(-1, STEP)
        each = np.zeros((len(self.blocks) + 1, symbols + 1), np.int32)
        np.add.at(each, (np.arange(n) // STEP + 1, self.last.astype(np.int64) + 1), 1)
        self.stored = np.cumsum(np.cumsum(each, 0, dtype=np.int32), 1, dtype=np.int32)
        self.first = self.stored[-1]

    def below(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i last symbols are less than `symbol`."""
        block, rest = i // STEP, i % STEP
        inside = (self.blocks[block] < symbol[:, None]) & (np.arange(STEP) < rest[:, None])
        return self.stored[block, symbol] + inside.sum(1)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rotations [low, high) with `symbol` put before them, and how many would come with a
        lesser symbol: by that the interval of the reversed pattern moves up in the other index."""
        less = self.below(np.tile(symbol, 2), np.concatenate((low, high)))
        upto = self.below(np.tile(symbol + 1, 2), np.concatenate((low, high)))
        rank, k = upto - less, len(symbol)
        return self.first[symbol] + rank[:k], self.first[symbol] + rank[k:], less[k:] - less[:k]


class Lexicon:
    """A bidirectional FM-index over distinct words with a delimiter (symbol 0) around each."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.alphabet, symbol = np.unique(codes, return_inverse=True)
        self.symbols = len(self.alphabet) + 1
        length = np.fromiter(map(len, words), np.int64, len(words))
        text = np.zeros(len(codes) + len(words) + 1, np.uint16 if self.symbols < 1 << 16 else np.uint32)
        text[np.arange(len(codes)) + np.repeat(np.arange(1, len(words) + 1), length)] = symbol + 1
        self.ways = Index(text, self.symbols), Index(text[::-1].copy(), self.symbols)
        # The rotations that begin with a delimiter come first: the word behind each of them.
        number = np.cumsum(text == 0) - 1
        self.owner = number[self.ways[0].rotations[: len(words) + 1]], len(words) - 1 - (
            np.cumsum(text[::-1] == 0) - 1
        )[self.ways[1].rotations[: len(words) + 1]]

    def encode(self, words: list[str], reverse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' symbols, each word followed by a delimiter; where each begins; its length."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(w[::-1] if reverse else w for w in words).encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        symbol = np.where(self.alphabet[at] == codes, at + 1, self.symbols)  # unknown: beyond all
        begin = np.cumsum(length + 1) - length - 1
        flat = np.zeros(len(codes) + len(words), np.int64)
        flat[np.arange(len(codes)) + np.repeat(np.arange(len(words)), length)] = symbol
        return flat, begin, length

    def one_edit(self, words: list[str], exact: np.ndarray, grow: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into words, word of the lexicon) that are one edit apart, found by a search
        scheme: the `exact` first (side 1: last) characters match exactly, extended across the rest
        with one edit. The other word is one longer where `grow`, else of equal length or one
        shorter; a pair may come twice."""
        inner, outer = self.ways[side], self.ways[1 - side]
        flat, begin, length = self.encode(words, reverse=side == 1)
        # From the middle outwards to the delimiter, keeping the interval of the other direction.
        who = np.arange(len(words))
        size = len(inner.last)
        low, high, far = np.zeros(len(words), np.int64), np.full(len(words), size), np.zeros(len(words), np.int64)
        for step in range(int(exact.max(initial=0)) + 1):
            who = who[(step <= exact[who]) & (low[who] < high[who])]
            left = exact[who] - 1 - step
            symbol = np.where(left >= 0, flat[begin[who] + np.maximum(left, 0)], 0)
            known = symbol < self.symbols
            low[who[~known]] = high[who[~known]]
            who, symbol = who[known], symbol[known]
            low[who], high[who], less = inner.extend(symbol, low[who], high[who])
            far[who] += less
        # The other way across the rest, with an edit.
        who = np.flatnonzero(low < high)
        at, wrong = exact[who], np.zeros(len(who), bool)
        low, high = far[who], far[who] + high[who] - low[who]
        found_who, found_word = [], []
        while len(who):
            symbol = flat[begin[who] + at]
            end = at == length[who]
            # The edit has been made, or comes later: the next character as it is.
            go = (wrong | ~end) & (symbol < self.symbols)
            a, b, _ = outer.extend(symbol[go], low[go], high[go])
            next_states = [(who[go], at[go] + 1, a, b, wrong[go])]
            # Left out here, the last of equal characters.
            gone = ~wrong & ~end & ~grow[who]
            gone[gone] = symbol[gone] != flat[begin[who[gone]] + at[gone] + 1]
            next_states.append((who[gone], at[gone] + 1, low[gone], high[gone], np.ones(gone.sum(), bool)))
            # Another one here, in its place or before it.
            put = np.flatnonzero(~wrong & ~(end & ~grow[who]))
            state, new = self._next_symbols(outer, put, low, high)
            other = new != symbol[state]
            state, new = state[other], new[other]
            a, b, _ = outer.extend(new, low[state], high[state])
            next_states.append((who[state], at[state] + ~grow[who[state]], a, b, np.ones(len(state), bool)))
            who, at, low, high, wrong = (np.concatenate(x) for x in zip(*next_states, strict=True))
            alive = low < high
            done = alive & (at > length[who])
            found_who.append(who[done])
            found_word.append(self.owner[1 - side][low[done]])
            alive &= ~done
            who, at, low, high, wrong = who[alive], at[alive], low[alive], high[alive], wrong[alive]
        return np.concatenate(found_who or [[]]).astype(int), np.concatenate(found_word or [[]]).astype(int)

    def _next_symbols(self, index: Index, states: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) of what may come next: read from short intervals, all symbols for long."""
        size = (high - low)[states]
        short, long = states[size < self.symbols], states[size >= self.symbols]
        many = (high - low)[short]
        row = np.repeat(low[short] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key = np.unique(np.repeat(short, many) * self.symbols + index.last[row])
        state, symbol = key // self.symbols, key % self.symbols
        state, symbol = state[symbol > 0], symbol[symbol > 0]
        every = np.arange(1, self.symbols)
        return (
            np.concatenate((state, np.repeat(long, len(every)))),
            np.concatenate((symbol, np.tile(every, len(long)))),
        )


def _pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """The near words inside whole cells. Cells share one lexicon: what it finds beyond a cell is
    as right as what it finds in it."""
    inside = rows[rows["held"]].drop_duplicates("word")
    words, counts = inside["word"].tolist(), inside["n"].to_numpy()
    found = [pd.DataFrame({"word": [], "n": [], "near": [], "near_n": []})]
    if words:
        lexicon = Lexicon(words)
        held = np.array(words, object)
        for side, part in rows[rows["asks"]].groupby("side"):
            part = part.drop_duplicates(["word", "longer"])
            asked = part["word"].tolist()
            longer = part["longer"].to_numpy()
            first = (np.fromiter(map(len, asked), np.int64, len(asked)) + longer) // 2
            # Sides share the longer word's length: its first half, or the rest of it.
            exact = first if side == 0 else np.fromiter(map(len, asked), np.int64, len(asked)) + longer - first
            who, word = lexicon.one_edit(asked, exact, longer.astype(bool), int(side))
            found.append(
                pd.DataFrame(
                    {"word": np.array(asked, object)[who], "n": part["n"].to_numpy()[who], "near": held[word], "near_n": counts[word]}
                )
            )
    return pd.concat(found)


def near_words(words: DataFrame, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """(word, n, near, near_n) of all pairs of `words` (word, n; each word once, of two characters or
    more) that differ by one inserted, deleted or replaced character, in both directions.

    Such a pair agrees in the first half or in the rest of the longer word (m characters). So a word
    goes to four cells, by (m, half, its characters there) for its own length as m and for one more,
    and cells are dealt over the tasks, where those that arrive together share a bidirectional
    FM-index. A cell of more than `piece` words is dealt out by pairs of pieces: the words of one
    are searched in the index of another.
    """
    length = F.length("word")
    places = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(side).alias("side"), F.lit(longer).alias("longer"),
                    (F.expr(f"substring(word, 1, int((length(word) + {longer}) / 2))") if side == 0 else
                     F.expr(f"right(word, length(word) + {longer} - int((length(word) + {longer}) / 2))")).alias("half"),
                )
                for side in (0, 1) for longer in (0, 1)
            )
        )
    )
    rows = words.select("word", "n", places.alias("place")).select(
        "word", "n", "place.side", "place.longer",
        F.sha2(F.concat_ws(":", length + F.col("place.longer"), "place.side", "place.half"), 256).alias("cell"),
    )
    sizes = rows.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    pieces = sizes.select("cell", F.ceil(F.col("size") / piece).cast("int").alias("pieces"))
    own = F.pmod(F.xxhash64("word", F.lit(3)), "pieces").cast("int")
    others = F.sequence(F.lit(0), F.col("pieces") - 1)
    asks = F.transform(
        others,
        lambda x: F.struct(x.alias("i"), F.col("own").alias("j"), F.lit(True).alias("asks"), (x == F.col("own")).alias("held")),
    )
    held = F.transform(
        F.filter(others, lambda x: x != F.col("own")),
        lambda x: F.struct(F.col("own").alias("i"), x.alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("held")),
    )
    rows = (
        rows.join(pieces, "cell")
        .withColumn("own", own)
        .select("word", "n", "side", "longer", "cell", F.explode(F.concat(asks, held)).alias("at"))
        .select("word", "n", "side", "longer", F.concat_ws(":", "cell", "at.i", "at.j").alias("cell"), "at.asks", "at.held")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            kept.append(batch)
            size += int(batch["word"].str.len().sum())
            if size >= shard:
                rows = pd.concat(kept)
                open_cell = rows["cell"] == rows["cell"].iloc[-1]
                yield _pairs(rows[~open_cell])
                kept = [rows[open_cell]]
                size = int(kept[0]["word"].str.len().sum())
        if kept:
            yield _pairs(pd.concat(kept))

    # Rows are small and searches long: the number of tasks follows the words, not the bytes.
    spread = rows.repartition(words.count() // ASKED + 1, "cell").sortWithinPartitions("cell")
    return map_pandas(spread, run, "word string, n long, near string, near_n long").distinct()


def _roots(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last, by doubling the hops."""
    reached = forms.select("word", F.col("form").alias("root"))
    done = 1
    while done < hops:
        reached = saved(reached)
        further = reached.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        reached = reached.join(further, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root")
        )
        done *= 2
    return reached


def spelling_groups(
    docs: DataFrame, typo_every: int = 199, least_chars: int = 6, least_count: int = 5, ratio: int = 5, *,
    doc_id="doc_id", text="text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of at least `least_chars` characters that
    occurs `least_count` times or more.

    near words differ by exactly one inserted, deleted or replaced character. A word's form is its
    most frequent near word (of equals the least in code-point order) if that is `ratio` times as
    frequent, else null; the root is where forms lead to, the word itself without one. Null and
    empty texts have no words; a null doc_id counts as an empty one; repeated rows count again;
    other columns are not read; an empty table gives an empty result. Words may be of any length.
    """
    words = saved(vocabulary(docs, typo_every, least_chars, least_count, doc_id=doc_id, text=text))
    near = near_words(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    told = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    form_n = -F.col("best.less")
    is_form = form_n >= ratio * F.col("n")
    told = saved(
        words.join(told, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, form_n).alias("form_n"),
        )
    )
    most = whole_number(words, F.max("n"))
    # Each hop leads to a word that is `ratio` times as frequent.
    hops = int(math.log(most / least_count, ratio) + 1e-9) + 1 if most else 0
    roots = _roots(told.where("form is not null"), hops)
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
