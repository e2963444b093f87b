"""Token counts of whole texts by a finite-state transducer compiled from a byte-pair vocabulary.

The encoding of a prefix ends in exactly one token, and that token is the one candidate that is compatible with the last
token of the shorter prefix before it. So a reader need only remember, for the few last positions at which a longer
token could still begin, which token ended there and how many tokens fewer had been counted: a finite state. States and
transitions are made when first met; a transition carries the change of the token count. No token crosses the border
before a space mark that follows another character, so texts fall into units there, the transducer starts anew at each,
and whole units become single transitions, kept with their counts.

A chunk of a long text is a map (head, count, tail): what stands before its first such border, the tokens up to the last,
and what stands after. Two neighbours compose by counting tail + head, which is associative, so the chunks of a text are
folded pairwise in a prefix scan.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmend.llm.common import text_of

MARK = "▁"
#: Characters of a text in one chunk; entries at which a worker's stores of units and of states start anew (token pairs:
#: twice as many).
CHUNK, STORE = 1 << 16, 1 << 18


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces with their scores; control, unknown, byte and unused pieces never come out of a merge."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (sp.is_byte, sp.is_control, sp.is_unknown, sp.is_unused)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not any(f(i) for f in skip)}


class Transducer:
    """Counts tokens of marked text (spaces as marks). ``stores`` are plain dicts that outlive a task in its worker."""

    def __init__(self, scores: dict[str, float], stores: dict[str, dict]):
        self.scores, self.stores = scores, stores
        if "heads" not in stores:
            stores["heads"] = {p[:k]: True for p in scores for k in range(1, len(p))}
            stores["alphabet"] = {c: True for p in scores for c in p}
            stores["pairs"], stores["units"], stores["bare"] = {}, {}, {}
            self._restart()
        self.heads, self.alphabet, self.pairs = stores["heads"], stores["alphabet"], stores["pairs"]

    def _restart(self) -> None:
        start = ("", ((None, 0),))
        self.stores["ids"], self.stores["states"], self.stores["moves"] = {start: 0}, [start], [{}]
        self.stores["ends"] = {}

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for short strings: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether b can follow a in an encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2 * STORE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def cost(self, token: str) -> int:
        return 1 if token in self.scores else len(token.encode("utf-8", "replace"))

    def _move(self, state: int, c: str) -> tuple[int, int]:
        window, ends = self.stores["states"][state]
        if c not in self.alphabet:  # bytes, and no merge reaches across
            return 0, self.cost(c)
        for k in range(len(ends) - 1, -1, -1):
            if ends[k] is None:
                continue
            token = window[len(window) - k:] + c
            last, fewer = ends[k]
            if (k == 0 or token in self.scores) and (last is None or self.fits(last, token)):
                break
        delta = fewer + self.cost(token)
        longer = window + c
        while longer and longer not in self.heads:
            longer = longer[1:]
        # ends[0] is the position just read, ends[k] the one k characters before, None where no token can still begin
        same = self.stores["ends"].setdefault
        nxt = (longer, ((token, 0), *[same(e, e) if (e := x and (x[0], x[1] - delta)) and longer[len(longer) - k:] in self.heads else None for k, x in enumerate(ends[:len(longer)], 1)]))
        ids = self.stores["ids"]
        if nxt not in ids:
            if len(ids) > STORE:
                self._restart()
                ids = self.stores["ids"]
            ids[nxt] = len(ids)
            self.stores["states"].append(nxt)
            self.stores["moves"].append(None)
        return ids[nxt], delta

    def run(self, unit: str) -> int:
        state, n, moves = 0, 0, self.stores["moves"]
        for c in unit:
            here = moves[state]
            if here is None:
                here = moves[state] = {}
            move = here.get(c)
            if move is None:
                move = here[c] = self._move(state, c)
                moves = self.stores["moves"]
            state, delta = move
            n += delta
        return n

    def unit(self, store: str, unit: str, part: str) -> int:
        known = self.stores[store]
        if len(known) > STORE:
            known.clear()
        n = self.run(unit)
        if len(part) < 64:
            known[part] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text that starts at a border; a space is a mark, and so is the mark itself."""
        units, bare, total = self.stores["units"], self.stores["bare"], 0
        lines = text.split("\n") if "\n" not in self.alphabet else [text]
        total += (len(lines) - 1) * self.cost("\n")
        for line in lines:
            parts = line.replace(MARK, " ").split(" ")
            n = bare.get(parts[0])
            total += self.unit("bare", parts[0], parts[0]) if n is None else n
            run = 0
            for p in parts[1:]:
                if not p:
                    run += 1
                elif run:
                    total += self.run(MARK * (run + 1) + p)
                    run = 0
                else:
                    n = units.get(p)
                    total += self.unit("units", MARK + p, p) if n is None else n
            if run:
                total += self.run(MARK * run)
        return total

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """The map of a chunk; without a border inside it the whole chunk is its head and the count is None."""
        first = last = -1
        at = text.find(" ", 1)
        while at > 0 and text[at - 1] in " " + MARK:
            at = text.find(" ", at + 1)
        if at < 1:
            return text, None, ""
        first, last = at, text.rfind(" ")
        while last > first and text[last - 1] in " " + MARK:
            last = text.rfind(" ", 0, last)
        return text[:first], self.count(text[first:last]) if last > first else 0, text[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and b[1] is None:
            # a border may lie just where the two meet
            return self.chunk(a[0] + b[0])
        if a[1] is None:
            return self._joined(a[0] + b[0], b[1], b[2])
        if b[1] is None:
            h, n, t = self.chunk(a[2] + b[0])
            return (a[0], a[1], a[2] + b[0]) if n is None else (a[0], a[1] + self.count(h) + n, t)
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def _joined(self, head: str, n: int, tail: str) -> tuple:
        h, more, rest = self.chunk(head)
        return (head, n, tail) if more is None else (h, more + self.count(rest) + n, tail)

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        maps = [self.chunk(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.count(" " + head) + (n or 0) + (self.count(tail) if n is not None else 0)


def counter(spark: SparkSession, path: str) -> Callable:
    """Column function: text to number of tokens. The vocabulary (its file bounds its size) goes to the workers once."""
    shared = spark.sparkContext.broadcast({"scores": read_vocabulary(path), "stores": {}})

    @F.pandas_udf(T.LongType())
    def n_tokens(texts: pd.Series) -> pd.Series:
        reader = Transducer(shared.value["scores"], shared.value["stores"])
        return texts.map(reader.tokens)

    return n_tokens


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes and 0 tokens. Nulls in doc_id and repeated rows come back as they are. An empty
    table gives no rows. Other columns are not read.
    """
    t = docs.select("doc_id", text_of().alias("t"))
    counted = t.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), counter(docs.sparkSession, path)("t").alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
