"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The merges are compiled step by step into a finite-state transducer over bytes. For every
prefix of a pre-token the last token of its encoding is unique, and a token may follow
another one exactly if the two stay apart when encoded together. A state therefore holds
the open token prefixes that reach the current byte, each with the token right before it,
and every move gives the last token of what has been read. Tokens that the paths of all
open prefixes share are sure and are emitted. An open prefix is no longer than the longest
token, which bounds the lookahead.

States, moves and the relation between tokens are made when a text first needs them, in
tables of bounded size. When the table of states is full, a word that leaves it is read to
its end without new states, on the token trie with its suffix links. The pre-tokens that a
block of texts has and a worker does not remember run through the machine side by side.

Nulls encode like the empty text: no ids. Ids are little-endian unsigned 32-bit integers
in one binary value; :func:`ids_array` turns them into a list. Repeated rows stay repeated,
other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Callable, Iterable
from array import array

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import Generations, once, share, text_udf

#: States of a worker, pairs of tokens whose relation it remembers, pre-tokens and texts
#: between blanks that one generation of its memory holds.
MAX_STATES = 30_000
MAX_PAIRS = 400_000
MAX_WORDS = 30_000
MAX_CHUNKS = 100_000
#: Longer pre-tokens are encoded each time instead of being kept.
LONG_WORD = 48
#: Bytes after which sure tokens of a long pre-token are emitted.
LOOKAHEAD = 128
#: Texts that are split and encoded together.
TEXTS = 256
#: Ids handed to the decoder at once.
DECODE_IDS = 8192

#: The pre-token pattern of the rank files in public use (fixed value).
BLANK_STARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOSE_BLANK = regex.compile(r"^ |\s |  | \s| $").search
TIGHT_BLANK = regex.compile(r"(?<=\S) (?=\S)").split

START = -1
ROOT = 0


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings and ranks of a tiktoken file, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes pre-tokens; its states and moves are made on demand."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.spelling = {rank: word for word, rank in ranks.items()}
        self.size = {rank: len(word) for word, rank in ranks.items()}
        self.max_states = max_states
        self.child: dict[int, int] = {}
        self.token_of = [START]
        self.depth = [0]
        self.above = [(ROOT, 0)]
        for word, rank in ranks.items():
            node = ROOT
            for byte in word:
                parent, node = node, self.child.setdefault(node << 8 | byte, len(self.token_of))
                if node == len(self.token_of):
                    self.token_of.append(START)
                    self.depth.append(self.depth[parent] + 1)
                    self.above.append((parent, byte))
            self.token_of[node] = rank
        self.apart: dict[int, bool] = {}
        self.suffix_of: dict[int, int] = {ROOT: ROOT}
        self.endings: dict[int, list[tuple[int, int]]] = {}
        self.number: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.start = self._state(((ROOT, START),))

    def _state(self, content: tuple) -> int:
        number = self.number.get(content)
        if number is None:
            number = self.number[content] = len(self.content)
            self.content.append(content)
        return number

    def suffix(self, node: int) -> int:
        """The trie node of the longest proper suffix that is in the trie."""
        known = self.suffix_of.get(node)
        if known is None:
            parent, byte = self.above[node]
            known = self.suffix_of[node] = ROOT if parent == ROOT else self.deepest(self.suffix(parent), byte)
        return known

    def deepest(self, node: int, byte: int) -> int:
        """The node of the longest suffix in the trie after one more byte."""
        while (to := self.child.get(node << 8 | byte)) is None and node != ROOT:
            node = self.suffix(node)
        return ROOT if to is None else to

    def tokens_at(self, node: int) -> list[tuple[int, int]]:
        """Tokens (with their sizes) that end at a node, the longest first."""
        known = self.endings.get(node)
        if known is None:
            known = [] if self.token_of[node] == START else [(self.token_of[node], self.depth[node])]
            if node != ROOT:
                known = known + self.tokens_at(self.suffix(node))
            self.endings[node] = known
        return known

    def merged(self, text: bytes) -> list[int]:
        """Ranks after merging a short byte string, lowest rank and leftmost pair first."""
        rank, never = self.ranks.get, len(self.ranks) + 1
        parts = [text[i:i + 1] for i in range(len(text))]
        pairs = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != never:
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], never)
        return [self.ranks[p] for p in parts]

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may come right after ``last`` (or first in a pre-token)."""
        key = (last + 1) << 32 | token
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= MAX_PAIRS:
                self.apart.clear()
            text = b"" if last == START else self.spelling[last]
            known = self.apart[key] = self.merged(text + self.spelling[token]) == ([token] if last == START else [last, token])
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte, and the last token of what has been read."""
        moved, ending, child, token_of = [], START, self.child.get, self.token_of
        for node, last in self.content[state]:
            deeper = child(node << 8 | byte)
            if deeper is not None:
                moved.append((deeper, last))
                if ending == START and (token := token_of[deeper]) != START and self.follows(last, token):
                    ending = token
        moved.append((ROOT, ending))
        move = self.moves[state << 8 | byte] = (self._state(tuple(moved)), ending)
        return move

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]  # a pre-token that is a token stays whole
        ends: list[int] = []
        state, known, full = self.start, self.moves.get, len(self.content) >= self.max_states
        for byte in word:
            move = known(state << 8 | byte)
            if move is None:
                if full:
                    return self._read_on(word, ends, self.content[state][0][0])
                move = self._move(state, byte)
                full = len(self.content) >= self.max_states
            state = move[0]
            ends.append(move[1])
            if len(ends) == LOOKAHEAD:
                return self._read_on(word, ends, self.content[state][0][0])
        return self._path(ends, len(ends))

    def _read_on(self, word: bytes, ends: list[int], node: int) -> list[int]:
        """The ids of a word whose first bytes have been read, without new states.

        ``ends`` is the last token after each byte, ``node`` the longest open prefix.
        """
        out: list[int] = []
        child, endings, known = self.child.get, self.endings.get, self.apart.get
        for byte in memoryview(word)[len(ends):]:
            node = child(node << 8 | byte) or self.deepest(node, byte)
            at = len(ends)
            for token, size in endings(node) or self.tokens_at(node):
                last = ends[at - size] if at >= size else START
                apart = known((last + 1) << 32 | token)
                if apart or apart is None and self.follows(last, token):
                    ends.append(token)
                    break
            if at > 2 * LOOKAHEAD:
                ends = ends[self._emit(node, ends, out):]
        return out + self._path(ends, len(ends))

    def _path(self, ends: list[int], at: int) -> list[int]:
        path = []
        while at:
            path.append(ends[at - 1])
            at -= self.size[path[-1]]
        return path[::-1]

    def _emit(self, node: int, ends: list[int], out: list[int]) -> int:
        """Move sure tokens to ``out``; returns the number of their bytes.

        One token before the open prefixes stays, since later tokens have to go with it.
        """
        places = {len(ends)}
        while node != ROOT:
            places.add(len(ends) - self.depth[node])
            node = self.suffix(node)
        while len(places) > 1:
            latest = max(places)
            places.remove(latest)
            places.add(latest - self.size[ends[latest - 1]])
        sure = places.pop()
        sure -= self.size[ends[sure - 1]] if sure else 0
        out += self._path(ends, sure)
        return sure


class IntTable:
    """Hash table from non-negative integers to small ones, for whole arrays at a time."""

    def __init__(self, capacity: int = 1 << 16):
        self._clear(capacity)

    def _clear(self, capacity: int) -> None:
        self.keys = np.full(capacity, -1, np.int64)
        self.values = np.zeros(capacity, np.int32)
        self.n = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - len(self.keys).bit_length() + 1)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are new and differ from each other."""
        if 3 * (self.n + len(keys)) > len(self.keys):
            held = np.flatnonzero(self.keys >= 0)
            keys, values = np.concatenate((self.keys[held], keys)), np.concatenate((self.values[held], values))
            self._clear(1 << (4 * len(keys)).bit_length())
        self.n += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        out = np.full(len(keys), default, np.int32)
        slots, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            held = self.keys[slots]
            hit = held == keys
            out[open_[hit]] = self.values[slots[hit]]
            on = ~hit & (held >= 0)
            keys, open_, slots = keys[on], open_[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out


class SideBySide:
    """The transducer for many short pre-tokens at once, in arrays."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.child = IntTable()
        keys = np.fromiter(machine.child, np.int64, len(machine.child))
        self.child.put(keys, np.fromiter(machine.child.values(), np.int32, len(keys)))
        n = len(machine.depth)
        self.suffix = np.fromiter(map(machine.suffix, range(n)), np.int32, n)
        machine.suffix_of = {ROOT: ROOT}  # a long pre-token asks for few of them
        self.endings = self._endings(np.array(machine.token_of, np.int32), np.array(machine.depth, np.int32))
        self.size = np.zeros(max(machine.size) + 1, np.int32)
        for token, size in machine.size.items():
            self.size[token] = size
        self.apart = IntTable()

    def _endings(self, token: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Tokens that end at each node, the longest first: its own, then those of its suffix."""
        own = token != START
        levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]
        count = np.zeros(len(token), np.int32)
        for nodes in levels:
            count[nodes] = count[self.suffix[nodes]] + own[nodes]
        out = np.full((len(token), max(1, int(count.max()))), START, np.int32)
        for nodes in levels:
            out[nodes] = out[self.suffix[nodes]]
            ends = nodes[own[nodes]]
            out[ends, 1:] = out[ends, :-1]
            out[ends, 0] = token[ends]
        return out

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = np.zeros(len(node), np.int32)
        open_ = np.arange(len(node))
        while len(open_):
            to = self.child.get(node.astype(np.int64) << 8 | byte, 0)
            out[open_] = to
            on = (to == ROOT) & (node != ROOT)
            open_, node, byte = open_[on], self.suffix[node[on]], byte[on]
        return out

    def _follows(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = (last.astype(np.int64) + 1) << 32 | token
        known = self.apart.get(keys, 2)
        new = np.unique(keys[known == 2])
        if len(new):
            if self.apart.n > MAX_PAIRS:
                self.apart = IntTable()
            answers = [self.machine.follows((k >> 32) - 1, k & 0xFFFFFFFF) for k in new.tolist()]
            self.machine.apart.clear()
            self.apart.put(new, np.array(answers, np.int32))
            known[known == 2] = self.apart.get(keys[known == 2], 0)
        return known == 1

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        length = sizes[order]
        longest = int(length[0]) if len(words) else 0
        text = np.zeros((len(words), longest), np.uint8)
        flat = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        text[np.arange(longest) < length[:, None]] = flat
        # the last token after each byte; words are ordered so that the longer ones go on
        ends = np.full((len(words), longest + 1), START, np.int32)
        node = np.zeros(len(words), np.int32)
        for at in range(longest):
            n = int(np.searchsorted(-length, -at, side="left"))
            node = self._next(node[:n], text[:n, at])
            rows = np.arange(n)
            for k in range(self.endings.shape[1]):
                token = self.endings[node[rows], k]
                some = token != START
                rows, token = rows[some], token[some]
                if not len(rows):
                    break
                fits = self._follows(ends[rows, at + 1 - self.size[token]], token)
                ends[rows[fits], at + 1] = token[fits]
                rows = rows[~fits]
        # walk back from the end of each word; its tokens fill a row from the right
        out = np.zeros((len(words), longest), np.uint32)
        count, place, rows = np.zeros(len(words), np.int64), length.copy(), np.arange(len(words))
        while len(rows := rows[place[rows] > 0]):
            token = ends[rows, place[rows]]
            count[rows] += 1
            out[rows, longest - count[rows]] = token
            place[rows] -= self.size[token]
        result: list[bytes] = [b""] * len(words)
        for i, row, k in zip(order.tolist(), out, count.tolist(), strict=True):
            whole = self.machine.ranks.get(words[i])
            result[i] = row[longest - k:].tobytes() if whole is None else array("I", [whole]).tobytes()
        return result


class Encoder:
    """Packed ids of whole texts by one vocabulary and pre-token pattern.

    Under :data:`BLANK_STARTS` a blank between two other characters than white space
    starts a pre-token, so the text between such blanks is looked up as a whole first.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.side_by_side = SideBySide(self.machine)
        self.pieces = regex.compile(pattern).findall
        self.blanks = pattern == BLANK_STARTS
        self.words, self.chunks = Generations(MAX_WORDS), Generations(MAX_CHUNKS)

    def _split(self, text: str | None) -> list[str]:
        """Parts of a text that are encoded each for itself."""
        if not text:
            return []
        if not self.blanks:
            return self.pieces(text)
        first, *rest = text.split(" ") if not LOOSE_BLANK(text) else TIGHT_BLANK(text)
        return [first, *[" " + part for part in rest]]

    def _words(self, words: set[str], whole: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens; those that are ``whole`` parts of a text are remembered as such."""
        found, missing = self.words.look_up(words)
        short = [w for w in missing if len(w) <= LONG_WORD]
        new = dict(zip(short, self.side_by_side.encode([w.encode("utf-8", "replace") for w in short]), strict=True)) if short else {}
        self.words.keep({w: ids for w, ids in new.items() if w not in whole})
        new |= {w: array("I", self.machine.encode(w.encode("utf-8", "replace"))).tobytes() for w in missing if len(w) > LONG_WORD}
        return found | new

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        return [ids for at in range(0, len(texts), TEXTS) for ids in self._block(texts[at:at + TEXTS])]

    def _block(self, texts: list[str | None]) -> list[bytes]:
        parts = [self._split(t) for t in texts]
        found, missing = self.chunks.look_up(set().union(*parts))
        pieces = [[part] if (own := self.pieces(part)) == [part] else own for part in missing]
        ids = self._words(set().union(*pieces), {own[0] for own in pieces if len(own) == 1})
        new = {part: b"".join([ids[p] for p in inside]) for part, inside in zip(missing, pieces, strict=True)}
        self.chunks.keep({part: packed for part, packed in new.items() if len(part) <= LONG_WORD})
        found |= new
        return [b"".join([found[p] for p in own]) for own in parts]


class Utf8Stream:
    """Bytes in pieces to text: a sequence cut between two pieces waits for its rest.

    Bytes that are not UTF-8 become U+FFFD; a sequence still open at the end as well.
    """

    def __init__(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, piece: bytes) -> str:
        return self.machine.decode(piece)

    def end(self) -> str:
        return self.machine.decode(b"", True)


def decoded(packed: bytes, spelling: dict[int, bytes], step: int = DECODE_IDS) -> str:
    """Text of packed ids, decoded as a stream; unknown ids become U+FFFD."""
    ids, stream = array("I"), Utf8Stream()
    ids.frombytes(packed)
    pieces = [stream.feed(b"".join([spelling.get(i, b"\xff") for i in ids[at:at + step]])) for at in range(0, len(ids), step)]
    return "".join(pieces) + stream.end()


class Codec:
    """Column functions for one vocabulary file and pre-token pattern."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        self.data = share(spark, {"ranks": ranks}, sum(map(len, ranks)) + 40 * len(ranks))
        self.pattern = pattern

    def encode(self, text: Column | str) -> Column:
        """Packed ids of each match of the pattern, one after the other."""
        data, pattern = self.data, self.pattern

        def make() -> Callable[[list], list]:
            encoder = once(data, "encoder", lambda d: Encoder(d["ranks"], pattern))
            return encoder.encode
        return text_udf(make, "binary")(text)

    def decode(self, ids: Column | str) -> Column:
        """Text of packed ids."""
        data = self.data

        def make() -> Callable[[list], list]:
            spelling = once(data, "spelling", lambda d: {rank: word for word, rank in d["ranks"].items()})
            return lambda rows: [decoded(r, spelling) if r else "" for r in rows]
        return text_udf(make, "string")(ids)

    def round_trip(self, text: Column | str) -> Column:
        """Struct of packed ids and the text they decode to, in one pass."""
        data, pattern = self.data, self.pattern

        def make() -> Callable[[list], list]:
            encoder = once(data, "encoder", lambda d: Encoder(d["ranks"], pattern))
            spelling = encoder.machine.spelling
            return lambda texts: [{"ids": ids, "decoded": decoded(ids, spelling)} for ids in encoder.encode(texts)]
        return text_udf(make, "struct<ids:binary,decoded:string>")(text)


def n_ids(ids: Column | str) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")


def ids_array(ids: Iterable[int] | bytes) -> list[int]:
    """Packed ids as a list."""
    out = array("I")
    out.frombytes(bytes(ids))
    return out.tolist()


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed), n_tokens, decoded (text) for every row of ``df``."""
    codec = Codec(df.sparkSession, ranks_path, pattern)
    rows = df.select(F.col(id_col).alias("doc_id"), codec.round_trip(F.coalesce(F.col(text_col), F.lit(""))).alias("r"))
    return rows.select("doc_id", "r.ids", n_ids("r.ids").alias("n_tokens"), "r.decoded")
