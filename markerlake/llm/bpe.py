"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a run of documents are laid out in one symbol array. An index maps each pair
that has a merge rank to all its positions; active ranks are taken in ascending order, all positions of a
rank are merged at once, and only the lists of the pairs that a merge touches are updated. Merge ranks are
checked on loading: a pair that holds a merge's product must rank behind that merge, so no lower rank can
appear later, and the order equals that of merging each word by itself.

Cases: null text is encoded as empty text; empty text has no ids and decodes to empty text; a text of any
length is taken in pieces of bounded size; repeated rows give repeated rows; extra columns are ignored by
`round_trip` and kept by `encode` and `decode`, whose output columns replace columns of the same name.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released

#: Characters of documents whose words are merged together, and cached words at most (both bound memory).
RUN_CHARS, CACHE_WORDS, LONG_TEXT, PIECE = 6_000_000, 400_000, 2_000_000, 65_536
#: The same for the library's words: characters looked up together, words known at most, words a text given to the library.
LIBRARY_RUN, KNOWN_WORDS, LINES = 2_000_000, 600_000, 1024

#: The pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_S, _L, _N = "\\t-\\r \\x85\\xa0", "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: The same pattern for texts within Latin-1, whose classes are short enough to spell out.
LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: White space as the pattern means it (Unicode White_Space), which leaves out 0x1C-0x1F.
ANY = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

NONE = np.int32(2**31 - 1)


def _pattern(text: str):
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ANY
    return LATIN


def _byte_chars() -> list[str]:
    """Printable stand-ins of the 256 bytes: a printable Latin-1 byte is itself, the others follow from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _splitter(special: dict[str, int]) -> re.Pattern | None:
    """Splits a text at special tokens, which are every second part."""
    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


class PairIndexBPE:
    """A vocabulary with its merges, from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = _byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_ids = np.array([vocab[c] for c in chars], np.int32)
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.ints, self.decimals = list(range(self.size)), [str(i) for i in range(self.size)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        rank_of = np.full(self.size, -1, np.int64)
        rank_of[made] = np.arange(len(pairs))
        if (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a token that a later merge makes")
        order = np.argsort(left * self.size + right, kind="stable")
        self._keys = (left * self.size + right)[order]
        self._ranks, self._made = order.astype(np.int32), made
        self.split_special = _splitter(self.special)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE where it has none or spans two words."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._ranks[at], NONE)

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all words merged together."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(n + 1) - n  # one separator before each word, one after the last
        sym = np.full(int(n.sum()) + len(raw) + 1, -1, np.int32)
        inside = np.ones(len(sym), bool)
        inside[starts - 1] = inside[-1] = False
        sym[inside] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        nxt = np.arange(1, len(sym) + 1, dtype=np.int32)
        prv = np.arange(-1, len(sym) - 1, dtype=np.int32)
        alive = inside.copy()
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self._rank(sym[:-1], sym[1:])
        index: dict[int, list[np.ndarray]] = {}

        def add(pos: np.ndarray, of: np.ndarray) -> None:
            keep = of != NONE
            pos, of = pos[keep], of[keep]
            if not len(pos):
                return
            order = np.argsort(of, kind="stable")
            pos, of = pos[order], of[order]
            cut = np.flatnonzero(of[1:] != of[:-1]) + 1
            edges = [0, *cut.tolist(), len(of)]
            for r, s, e in zip(of[edges[:-1]].tolist(), edges, edges[1:]):
                if r in index:
                    index[r].append(pos[s:e])
                else:
                    index[r] = [pos[s:e]]
                    heapq.heappush(active, r)

        active: list[int] = []
        add(np.arange(len(sym), dtype=np.int32), rank)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            if len(pos) > 1 and sym[pos[0]] == sym[nxt[pos[0]]]:  # a run of one symbol: pairs from the left
                k = np.arange(len(pos))
                first = np.maximum.accumulate(np.where(np.r_[True, pos[1:] != nxt[pos[:-1]]], k, 0))
                pos = pos[(k - first) % 2 == 0]
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = self._made[r]
            alive[gone] = False
            rank[gone] = NONE
            nxt[pos], prv[after] = after, pos
            before = prv[pos]
            touched = np.concatenate((before, pos))
            new = self._rank(sym[touched], sym[nxt[touched]])
            rank[touched] = new
            add(touched, new)
        word = np.cumsum(~inside)[alive] - 1
        ids = list(map(self.ints.__getitem__, sym[alive].tolist()))
        ends = np.cumsum(np.bincount(word, minlength=len(raw))).tolist()
        return [ids[s:e] for s, e in zip([0, *ends], ends)]


class _Words(dict):
    """Ids by word. A word not seen before gets an empty list that fill() completes."""

    def __init__(self):
        self.pending: list[str] = []

    def __missing__(self, word: str) -> list[int]:
        self.pending.append(word)
        found = self[word] = []
        return found


class Encoder:
    """Encodes texts piece by piece with a bounded cache of words."""

    def __init__(self, bpe: PairIndexBPE):
        self.bpe, self.words = bpe, _Words()
        self.whole = {t: [i] for t, i in bpe.special.items()}

    def pieces(self, text: str) -> Iterator[list[list[int]]]:
        """Lists of word ids; fill() must run before they are read."""
        get = self.words.__getitem__
        parts = self.bpe.split_special.split(text) if self.bpe.special and any(t in text for t in self.bpe.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [self.whole[part]]
            elif len(part) <= LONG_TEXT:
                yield list(map(get, _pattern(part).findall(part)))
            else:
                found = _pattern(part).finditer(part)
                while got := [get(m.group()) for m in islice(found, PIECE)]:
                    yield got

    def fill(self) -> None:
        if self.words.pending:
            pending, self.words.pending = self.words.pending, []
            for w, ids in zip(pending, self.bpe.merge_words(pending)):
                self.words[w].extend(ids)

    def trim(self) -> None:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()

    def ids(self, texts: list[str | None]) -> Iterator[Iterator[list[int]]]:
        """For each text an iterator over lists of ids. Texts up to RUN_CHARS together are merged together;
        a longer one is filled piece by piece."""
        run: list[list] = []
        chars = 0

        def flush():
            self.fill()
            for pieces in run:
                yield (list(chain.from_iterable(p)) for p in pieces)
            self.trim()

        def long(text: str):
            for p in self.pieces(text):
                self.fill()
                yield list(chain.from_iterable(p))
                self.trim()

        for t in texts:
            t = t or ""
            if len(t) > LONG_TEXT:
                yield from flush()
                run, chars = [], 0
                yield long(t)
                continue
            run.append(list(self.pieces(t)))
            chars += len(t)
            if chars >= RUN_CHARS:
                yield from flush()
                run, chars = [], 0
        yield from flush()


class _Numbers(dict):
    """Words numbered in the order in which they are first seen."""

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        return k


class LibraryEncoder:
    """Encodes texts with the tokenizers library, which gives the ids of distinct words. Words are numbered, the ids of
    all known ones lie in one array, and a run of texts gathers its ids from there at once. Too many words: those met
    once since the last time go, the most used others stay."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation(), self.tok.no_padding()
        self.newline = self.tok.encode("\n", add_special_tokens=False).ids
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.split_special = _splitter(self.special)
        self.words = _Numbers({t: k for k, t in enumerate(self.special)})  # no other word holds a special token's text
        self.pool = np.array(list(self.special.values()), np.uint32)
        self.starts, self.sizes, self.uses = np.arange(len(self.words)), np.ones(len(self.words), np.int64), np.zeros(len(self.words), np.int64)

    def _numbers(self, text: str) -> Iterator[np.ndarray]:
        """The words' numbers, piece by piece; fill() must run before their ids are read, and trim() after that."""
        get = self.words.__getitem__
        parts = self.split_special.split(text) if any(t in text for t in self.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield np.array([get(part)])
            elif len(part) <= LONG_TEXT:
                found = _pattern(part).findall(part)
                yield np.fromiter(map(get, found), np.int64, len(found))
            else:
                found = _pattern(part).finditer(part)
                while got := [get(m.group()) for m in islice(found, PIECE)]:
                    yield np.array(got)

    def _encode(self, words: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Positions of the words in a new order, and in that order their numbers of ids and their ids.
        Words without inner white space go together as lines of one text: a line end is a pre-token of its own there, so
        each keeps its ids, and one encoding serves hundreds. The others go one by one."""
        plain = [k for k, w in enumerate(words) if len(w) > 1 and (w[0] == " " or not w[0].isspace()) and w[1:].split() == [w[1:]]] if len(self.newline) == 1 else []
        order: list[int] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        done = set()
        for k in range(0, len(plain), LINES):
            part = plain[k : k + LINES]
            (e,) = self.tok.encode_batch_fast(["\n".join([words[p] for p in part])], add_special_tokens=False)
            flat = np.array(e.ids, np.uint32)
            at_line = flat == self.newline[0]
            n = np.diff(np.flatnonzero(at_line), prepend=-1, append=len(flat)) - 1
            if len(n) == len(part) and n.all():
                order += part
                sizes.append(n)
                ids.append(flat[~at_line])
                done.update(part)
        rest = [k for k in range(len(words)) if k not in done]
        for k in range(0, len(rest), LINES):
            found = [e.ids for e in self.tok.encode_batch_fast([words[p] for p in rest[k : k + LINES]], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids += [np.array(f, np.uint32) for f in found]
        return order + rest, sizes, ids

    def fill(self) -> None:
        """Ids of the words numbered since the last time."""
        known = len(self.starts)
        if len(self.words) > known:
            order, sizes, ids = self._encode(list(islice(self.words, known, None)))
            n = np.concatenate(sizes)
            here = np.empty((2, len(n)), np.int64)
            here[:, order] = len(self.pool) + np.cumsum(n) - n, n
            self.starts, self.sizes = np.concatenate((self.starts, here[0])), np.concatenate((self.sizes, here[1]))
            self.uses = np.concatenate((self.uses, np.zeros(len(n), np.int64)))
            self.pool = np.concatenate((self.pool, *ids))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and where each word's ids end."""
        n = self.sizes[numbers]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.starts[numbers] - (ends - n), n) + np.arange(int(n.sum()))], ends

    def _taken(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.fill()
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        found = self._gather(numbers)
        self.trim()
        return found

    def trim(self) -> None:
        if len(self.words) <= KNOWN_WORDS and len(self.pool) <= 8 * KNOWN_WORDS:
            return
        stay = np.flatnonzero((self.uses > 1) & (self.sizes <= 64))
        if len(stay) > KNOWN_WORDS // 2:
            stay = np.sort(stay[np.argpartition(self.uses[stay], -(KNOWN_WORDS // 2))[-(KNOWN_WORDS // 2) :]])
        if self.sizes[stay].sum() > 4 * KNOWN_WORDS:
            stay = stay[:0]
        first = len(self.special)
        stay = np.concatenate((np.arange(first), stay[stay >= first]))
        words = list(self.words)
        self.words.clear()
        self.words.update(zip([words[k] for k in stay.tolist()], range(len(stay))))
        self.pool, ends = self._gather(stay)
        self.sizes = self.sizes[stay]
        self.starts, self.uses = ends - self.sizes, np.zeros(len(stay), np.int64)

    def ids(self, texts: list[str | None]) -> Iterator[Iterator[np.ndarray]]:
        """For each text an iterator over arrays of ids. Texts up to LIBRARY_RUN characters together are looked up
        together; a longer one is taken piece by piece."""
        run: list[np.ndarray] = []
        counts: list[int] = []  # arrays of each text of the run
        chars = 0

        def flush():
            if run:
                ids, ends = self._taken(np.concatenate(run))
                at = np.concatenate(([0], ends))[np.cumsum([0, *map(len, run)])].tolist()  # where each array's ids begin
            k = 0
            for n in counts:
                yield iter([ids[at[k] : at[k + n]]] if n else [])
                k += n

        def long(text: str):
            for numbers in self._numbers(text):
                yield self._taken(numbers)[0]

        for t in texts:
            t = t or ""
            if len(t) > LONG_TEXT:
                yield from flush()
                run, counts, chars = [], [], 0
                yield long(t)
                continue
            before = len(run)
            run += self._numbers(t)
            counts.append(len(run) - before)
            chars += len(t)
            if chars >= LIBRARY_RUN:
                yield from flush()
                run, counts, chars = [], [], 0
        yield from flush()


_loaded: dict[tuple, Encoder | LibraryEncoder] = {}


def encoder(path: str, library: bool = False) -> Encoder | LibraryEncoder:
    """One encoder for each Python worker. library: the tokenizers library gives the ids of distinct words."""
    if (path, library) not in _loaded:
        _loaded[path, library] = LibraryEncoder(path) if library else Encoder(PairIndexBPE(path))
    return _loaded[path, library]


def decode_ids(bpe: PairIndexBPE, ids: list[int]) -> str:
    """The text of ids; bytes that are no UTF-8 become the replacement character."""
    return b"".join(map(bpe.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with the ids of each text as an array column."""
    keep = [c for c in docs.columns if c != out]
    schema = f"{', '.join(f'`{c}` {t}' for c, t in docs.dtypes if c != out)}, `{out}` array<int>".removeprefix(", ")

    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids = [list(chain.from_iterable(p)) for p in enc.ids(b.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, out])

    return docs.mapInArrow(released(run), schema)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of each array of ids; a null array gives a null text."""
    keep = [c for c in encoded.columns if c != out]
    schema = f"{', '.join(f'`{c}` {t}' for c, t in encoded.dtypes if c != out)}, `{out}` string".removeprefix(", ")

    def run(batches):
        bpe = encoder(path).bpe
        for b in batches:
            texts = [None if x is None else decode_ids(bpe, x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    return encoded.mapInArrow(released(run), schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes each whole text, decodes the ids again, and gives digests of both: doc_id, n_tokens,
    ids_sha256, decoded_sha256. Ids are handled piece by piece, so no text's ids are ever held twice."""

    def run(batches):
        enc = encoder(path)
        table, dec = enc.bpe.token_bytes.__getitem__, enc.bpe.decimals.__getitem__
        for b in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for pieces in enc.ids(b.column("text").to_pylist()):
                n, sha, back, text = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
                for ids in pieces:
                    if ids:
                        sha.update(((b"," if n else b"") + ",".join(map(dec, ids)).encode()))
                        back.update(text.decode(b"".join(map(table, ids))).encode())
                        n += len(ids)
                back.update(text.decode(b"", True).encode())
                for column, x in zip(rows, (n, sha.hexdigest(), back.hexdigest())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows[0], pa.int64()), *(pa.array(x, pa.string()) for x in rows[1:])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
