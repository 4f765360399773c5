"""Whole-text encoding with the tokenizers library, equal to its own result and several times
faster on natural text: a text is cut where the pre-tokenizer would cut it whatever stands
around, each distinct chunk is encoded once, and the ids of all chunks are gathered from one table.
``TreeEncoder`` encodes long texts by tree concatenation, with that table at its leaves.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Entries of a worker's chunk table, unless its user asks for less; when it is full, the half that is used most stays.
CACHE_ENTRIES = 300_000
#: Only chunks up to this length are kept in the table.
CACHE_CHARS = 48
#: Bytes of text that are worked on at once.
PIECE_BYTES = 2 << 20
#: Bytes of text after which a worker that keeps a table gives free memory back.
TRIM_BYTES = 8 << 20

_MARKS = string.punctuation
_SAFE_CUT = re.compile(r"(?<=\S)(?= [^\s\u180e])(?<!\u180e)")
#: Stands before a chunk that has no space before it.
_NO_SPACE = "\x02"
#: Texts with more white space than single spaces and line feeds between words, or control
#: characters; where white space is dropped, texts that lower case could change otherwise.
_ODD_SPACED = r"(?s)\A[ \n]|[ \n]\z|[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]"
_ODD_DROPPED = r"<\||\p{M}"


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[slice]:
    """Runs of rows with up to ``most`` bytes of text, or of one longer text; null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(start, stop)
        start = stop


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]`` one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by the published rule: printable
    Latin-1 bytes stand for themselves, the others for code points from 256 on, in order."""
    keep = {b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)}
    rest = iter(range(256, 512))
    return {chr(b) if b in keep else chr(next(rest)): b for b in range(256)}


class ChunkTable:
    """Chunks by name, with the ids of all of them in one array."""

    def __init__(self, most: int | None = None) -> None:
        self.most = most
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size, self.uses = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.entries = 0

    def add(self, names: list[str] | None, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Appends entries, named or, until the next ``forget``, by number alone; the first one's number."""
        first, n = self.entries, len(sizes)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + n > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size, self.uses))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.uses[first : first + n] = 0
        self.used += len(ids)
        self.entries += n
        if names is not None:
            self.index.update(zip(names, range(first, first + n), strict=True))
        return first

    def forget(self) -> None:
        """Drops nameless entries, which stand at the end, and of a full table what is used least."""
        named = len(self.index)
        if named < self.entries:
            self.used = int(self.start[named]) if named else 0
            self.entries = named
        most = self.most or CACHE_ENTRIES
        if named <= most:
            return
        uses = self.uses[:named]
        keep = np.sort(np.argsort(-uses, kind="stable")[: most // 2])
        keep = keep[uses[keep] > 1]
        names = list(self.index)
        ids, sizes, uses = gathered(self.flat, self.start[keep], self.size[keep]), self.size[keep], uses[keep] // 2
        self.index, self.used, self.entries = {}, 0, 0
        self.add([names[k] for k in keep.tolist()], ids, sizes)
        self.uses[: len(keep)] = uses


class Merges:
    """The merges of a byte-level vocabulary, applied to many pre-tokens at once.

    In each round every pre-token makes its first merge of the lowest rank, as the published
    algorithm does one by one, until none has a pair left that merges. Works on arrays throughout.
    """

    NONE = 1 << 30
    BITS = 18

    @staticmethod
    def fits(spec: dict) -> bool:
        model = spec.get("model") or {}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        vocab, suffix = model.get("vocab") or {}, model.get("end_of_word_suffix") or ""
        return model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in odd) and 0 < len(vocab) < 1 << 16 and max(vocab.values()) < 1 << 16 and all(c in vocab and c + suffix in vocab for c in byte_alphabet())

    def __init__(self, spec: dict, spaced: bool):
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.first, self.last = np.empty(256, np.int32), np.empty(256, np.int32)
        for c, byte in byte_alphabet().items():
            self.first[byte], self.last[byte] = vocab[c], vocab[c + suffix]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys, self.ranks = np.full(1 << self.BITS, 2**64 - 1, np.uint64), np.full(1 << self.BITS, self.NONE, np.int32)
        for rank, (at, key) in enumerate(zip(self._place(keys).tolist(), keys.tolist(), strict=True)):
            while self.keys[at] != 2**64 - 1 and self.keys[at] != key:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ranks[at] = key, rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)
        at = self._place(keys)
        out, open_ = self.ranks[at], np.flatnonzero(self.keys[at] != keys)
        while len(open_):
            free = self.keys[at[open_]] == np.uint64(2**64 - 1)
            out[open_[free]] = self.NONE
            open_ = open_[~free]
            at[open_] = (at[open_] + 1) % len(self.keys)
            out[open_] = self.ranks[at[open_]]
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        return out

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, none of them empty, and how many each has."""
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int32)[1 : len(words) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[: ends[-1]]
        counts = np.diff(ends, prepend=0)
        s = self.first[raw]
        s[ends - 1] = self.last[raw[ends - 1]]
        name = np.arange(len(words), dtype=np.int32)
        word = np.repeat(name, counts)  # places in ``name``
        rank = np.full(len(s), self.NONE, np.int32)
        rank[:-1] = self._rank(s[:-1], s[1:])
        rank[ends - 1] = self.NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(s):
            low = np.minimum.reduceat(rank, np.cumsum(counts) - counts)
            live = low < self.NONE
            if not live.all():
                on = live[word]
                done.append((name[word[~on]], s[~on]))
                s, rank, word = s[on], rank[on], (np.cumsum(live, dtype=np.int32) - 1)[word[on]]
                name, counts, low = name[live], counts[live], low[live]
                if not len(s):
                    break
            hit = np.flatnonzero(rank == low[word])
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            s[hit] = self.made[rank[hit]]
            keep = np.ones(len(s), bool)
            keep[hit + 1] = False
            s, rank, word = s[keep], rank[keep], word[keep]
            counts = counts - 1
            at = hit - np.arange(len(hit))
            nxt = np.minimum(at + 1, len(s) - 1)
            rank[at] = np.where((nxt > at) & (word[nxt] == word[at]), self._rank(s[at], s[nxt]), self.NONE)
            before = at[(at > 0) & (word[at - 1] == word[at])]
            rank[before - 1] = self._rank(s[before - 1], s[before])
        names, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(names, kind="stable")].astype(np.uint32), np.bincount(names, minlength=len(words))


class ChunkEncoder:
    """Encodes texts to token ids.

    ``spaced``: the vocabulary's pre-tokenizer keeps a space with the word after it (byte-level
    BPE); else it drops white space (BPE with word ends).
    """

    def __init__(self, data: bytes, entries: int | None = None):
        self.tok = Tokenizer.from_buffer(data)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(data)
        added = spec.get("added_tokens") or []
        pre = spec.get("pre_tokenizer") or {}
        self.spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        self.dropped = _drops_white_space(spec)
        self.plain = all(not (t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")) and not re.search(r"\s", t["content"]) for t in added)
        #: Cutting is exact for these two forms of tokenizer only; others take texts whole.
        self.cuts = self.plain and (self.spaced or self.dropped)
        self.specials = [t["content"] for t in added]
        self.table = ChunkTable(entries)
        self.merges = Merges(spec, self.spaced) if self.cuts and Merges.fits(spec) else None

    # -- cutting ---------------------------------------------------------------------------
    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct chunks of the texts; the chunks of all texts, by number; and how many
        each text has, one at least."""
        if not self.cuts:
            made = texts.dictionary_encode()
            return made.dictionary, made.indices.to_numpy(), np.ones(len(texts), np.int64)
        odd = pc.match_substring_regex(texts, _ODD_SPACED if self.spaced else _ODD_DROPPED)
        if self.spaced:  # a chunk is a word with the space before it, or with the line feed before it
            cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(_NO_SPACE, texts, ""), "\n", " \n"), " ")
        else:
            cut = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        if pc.any(odd).as_py():
            parts = [self._cut_odd(t) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
            cut = pc.if_else(odd, pa.array(parts, cut.type), cut)
        made = cut.flatten().dictionary_encode()
        return made.dictionary, made.indices.to_numpy(), pc.list_value_length(cut).to_numpy().astype(np.int64)

    def _cut_odd(self, text: str) -> list[str]:
        if self.spaced:
            return [_NO_SPACE + c for c in _SAFE_CUT.split(text)]
        return text.replace("\n", " ").split(" ")

    def literal(self, chunks: list[str]) -> list[str]:
        """The chunks as they stand in the texts."""
        if not (self.cuts and self.spaced):
            return chunks
        return [c[1:] if c[:1] == _NO_SPACE else c if c[:1] == "\n" else " " + c for c in chunks]

    # -- encoding --------------------------------------------------------------------------
    def raw(self, texts: list[str]) -> list[list[int]]:
        """The library's own encoding."""
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_tokens(self, chunk: str) -> tuple[str, ...] | None:
        """The pre-tokens of a chunk of letters and then ASCII marks, the usual case; else None."""
        word = chunk.rstrip(_MARKS)
        marks = chunk[len(word) :]
        head = word[1:] if word[:1] in (" ", "\n") else word
        if "<" in marks or head and not head.isalpha() or self.dropped and len(head) < len(word):
            return None
        if self.dropped and not head.islower() and head:  # as the normalizer leaves it
            if not head.isascii():
                return None
            head = word = head.lower()
        elif self.dropped and not head.isascii() and not (head == head.lower() and unicodedata.is_normalized("NFC", head)):
            return None
        if word[:1] == "\n":
            return tuple(p for p in ("\n", head, marks) if p)
        return (word, marks) if head and marks else (word + marks,) if chunk else None

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks in order, and how many each has."""
        run: list[str] = []
        several: list[int] = []
        rest: list[int] = []
        for k, c in enumerate(chunks):
            if self.spaced and c[1:].isalpha() and (c[0] == " " or c[0].isalpha()):
                parts = (c,)
            else:
                parts = self._pre_tokens(c)
            if parts and self.merges:
                run += parts
                several.append(len(parts))
            else:
                rest.append(k)
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        if run:
            made, counts = self.merges.encode(pa.array(run, pa.string()))
            ids.append(made)
            sizes.append(np.add.reduceat(counts, np.cumsum([0, *several[:-1]])))
        for i in range(0, len(rest), 4096):
            made = self.raw([chunks[k] for k in rest[i : i + 4096]])
            sizes.append(np.fromiter(map(len, made), np.int64, len(made)))
            ids.append(np.fromiter(chain.from_iterable(made), np.uint32, int(sizes[-1].sum())))
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        if not rest or not run:
            return flat, size
        last = np.zeros(len(chunks), bool)
        last[rest] = True
        place = np.empty(len(chunks), np.int64)
        place[np.concatenate([np.flatnonzero(~last), rest])] = np.arange(len(chunks))
        return gathered(flat, (np.cumsum(size) - size)[place], size[place]), size[place]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; null is empty."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        table = self.table
        table.forget()
        distinct, number, counts = self.chunks(texts)
        names = self.literal(distinct.to_pylist())
        where = np.fromiter(map(table.index.get, names, repeat(-1)), np.int64, len(names))
        new = where < 0
        long = pc.utf8_length(distinct).to_numpy() > CACHE_CHARS
        for at, kept in ((np.flatnonzero(new & ~long), True), (np.flatnonzero(new & long), False)):
            if len(at):
                # a name can stand for two chunks, one cut by each way
                part = dict.fromkeys([names[k] for k in at.tolist()])
                first = table.add(list(part) if kept else None, *self._encoded(list(part)))
                if len(part) == len(at):
                    where[at] = np.arange(first, first + len(at))
                else:
                    part = dict(zip(part, range(first, first + len(part)), strict=True))
                    where[at] = [part[names[k]] for k in at.tolist()]
        table.uses[where] += np.bincount(number, minlength=len(names))
        size = table.size[where]
        own = gathered(table.flat, table.start[where], size)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(own))
        return lists.take(pa.array(number)).flatten().to_numpy(), np.add.reduceat(size[number], np.cumsum(counts) - counts)


_KEPT: dict[tuple, ChunkEncoder] = {}


def encoder_for(data: bytes, entries: int | None = None) -> ChunkEncoder:
    """A worker's encoder for a vocabulary, kept between tasks with what it has learned."""
    key = (hash(data), len(data), entries)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = ChunkEncoder(data, entries)
    return _KEPT[key]


def release() -> None:
    """Gives back what this worker keeps of earlier tasks: workers serve the tasks of all operators in
    turn, and the table of one must not add to the memory of the next."""
    _KEPT.clear()
    trim()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that keeps nothing before or after: an idle worker's memory counts beside the stages that
    need no Python, too."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return alone


def trim() -> None:
    """Gives free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _drops_white_space(spec: dict) -> bool:
    """Whether white space only parts words: a split that removes what its pattern leaves out."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    return pre.get("type") == "Sequence" and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "\\s" in str(first.get("pattern"))


class TreeEncoder:
    """Exact encoding of long texts by tree concatenation.

    A text is halved down to leaves of up to ``leaf_chars``; all leaves of all texts are encoded in
    one call; then, level by level, a window around each join is encoded and grown until its first
    tokens are the left side's and its last tokens the right side's. A byte-pair encoding is right
    if each pair of neighbouring tokens is one that the merges would leave apart, so sides that
    share tokens with an exact window join to an exact whole. Window ends are ends of tokens, where
    the pre-tokenizer sees the same with or without what is cut off: between two letters or two
    digits, or before a space between words. Where no such place agrees, the window grows to the
    whole of both sides.
    """

    #: Tokens that must agree on either side of the window.
    AGREE = 4

    def __init__(self, encoder: ChunkEncoder, leaf_chars: int = 2048):
        if not (encoder.spaced and encoder.plain):
            raise ValueError("tree concatenation is for byte-level vocabularies")
        self.encoder, self.leaf_chars = encoder, max(64, leaf_chars)
        special = "|".join(re.escape(s) for s in sorted(encoder.specials, key=len, reverse=True))
        self.special = re.compile(f"({special})") if special else None
        alphabet = byte_alphabet()
        specials = set(encoder.specials)
        vocab = encoder.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = [0] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token.encode()) if token in specials else sum(1 for c in token if c in alphabet)
        self.leaves = self.joins = self.windows = 0  # counts of the work done

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As ``ChunkEncoder.encode``."""
        parts: list[str] = []  # runs of text between special tokens, and those
        owner: list[int] = []
        for k, t in enumerate(texts):
            t = t or ""
            split = [p for p in self.special.split(t) if p] if self.special and "<" in t else [t]
            parts += split
            owner += [k] * len(split)
        leaves = [self._leaves(p) for p in parts]
        self.leaves += sum(map(len, leaves))
        ids, sizes = self.encoder.encode(list(chain.from_iterable(leaves)))
        ends = np.cumsum(sizes)
        whole = iter(zip(chain.from_iterable(leaves), np.split(ids, ends[:-1]) if len(ends) else [], strict=True))
        trees = [[next(whole) for _ in group] for group in leaves]
        while any(len(t) > 1 for t in trees):
            joins = [(t[i], t[i + 1]) for t in trees for i in range(0, len(t) - 1, 2)]
            joined = iter(self._join(joins))
            trees = [[next(joined) if i + 1 < len(t) else t[i] for i in range(0, len(t), 2)] for t in trees]
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, np.array(owner, np.int64), [len(t[0][1]) for t in trees])
        return np.concatenate([t[0][1] for t in trees]) if trees else np.empty(0, np.uint32), counts

    def _leaves(self, text: str) -> list[str]:
        """Halves of halves. A middle next to white space moves on to one inside a word, if near."""
        if len(text) <= self.leaf_chars:
            return [text]
        mid = len(text) // 2
        near = range(mid, min(mid + 24, len(text) - 1))
        mid = next((k for k in near if not text[k - 1].isspace() and not text[k].isspace()), mid)
        return self._leaves(text[:mid]) + self._leaves(text[mid:])

    def _end(self, text: str, ids: np.ndarray, back: bool, most: int) -> tuple[int, int] | None:
        """(token index, characters from the join) of the farthest end that a window may have."""
        side = text[-most:] if back else text[:most]
        near = ids[-most:][::-1].tolist() if back else ids[:most].tolist()
        data = side.encode("utf-8", "replace")
        size, best = 0, None
        for k, token in enumerate(near):
            size += self.bytes_of[token]
            if size >= len(data):
                break
            at = len(data) - size if back else size
            if data[at] & 0xC0 == 0x80:  # inside a character
                continue
            chars = len(data[at:].decode()) if back else len(data[:at].decode())
            where = len(text) - chars if back else chars
            a, b, c = text[where - 1], text[where], text[where + 1 : where + 2]
            inside = (a.isalpha() and b.isalpha()) or (a.isdecimal() and b.isdecimal())
            if inside or (b == " " and c and not (a.isspace() or c.isspace() or "᠎" in (a, c))):
                best = (len(ids) - 1 - k if back else k + 1, chars)
        return best

    def _join(self, pairs: list[tuple]) -> list[tuple[str, np.ndarray]]:
        """Joins pairs of (text, ids); the windows of all of them are encoded together."""
        self.joins += len(pairs)
        done: dict[int, np.ndarray] = {}
        width = 32
        while len(done) < len(pairs):
            tried, windows = [], []
            for p, ((left, a), (right, b)) in enumerate(pairs):
                if p in done:
                    continue
                if width >= max(len(left), len(right)):
                    tried.append((p, None))
                    windows.append(left + right)
                    continue
                la, rb = self._end(left, a, True, width), self._end(right, b, False, width)
                if la and rb:
                    tried.append((p, (la[0], rb[0])))
                    windows.append(left[len(left) - la[1] :] + right[: rb[1]])
            self.windows += len(windows)
            for (p, ends), found in zip(tried, self.encoder.raw(windows), strict=True):
                ids = np.array(found, np.uint32)
                if ends is None:
                    done[p] = ids
                    continue
                (_, a), (_, b), (i, j), n = *pairs[p], ends, self.AGREE
                if len(ids) > 2 * n and i + n <= len(a) and j >= n and found[:n] == a[i : i + n].tolist() and found[-n:] == b[j - n : j].tolist():
                    done[p] = np.concatenate([a[:i], ids, b[j:]])
            width *= 2
        return [(left + right, done[p]) for p, ((left, _), (right, _)) in enumerate(pairs)]


class Decoder:
    """Decoding of byte-level vocabularies, special tokens kept: the tokens' bytes in order."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        if (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("the tokenizer does not decode by bytes")
        alphabet = byte_alphabet()
        added = {t["content"] for t in spec.get("added_tokens") or []}
        vocab = Tokenizer.from_buffer(data).get_vocab(with_added_tokens=True)
        self.table = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.table[i] = token.encode() if token in added else bytes(alphabet[c] for c in token)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))
