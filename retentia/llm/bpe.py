"""Byte-pair encoding and decoding of whole texts by speculation and verification.

Greedy longest match proposes the tokens of a word. The proposal is the encoding exactly if every
token stands for itself and no two neighbours would have grown together: both are checked for all
words at once with arrays. Only words that fail are merged rule by rule.

Encodings equal those of the public tokenizer file with ``add_special_tokens=False``: its special
strings are found inside texts, everything else is normalised, cut into words and encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers

from retentia.llm.batches import on_workers, pieces_of, texts_of

#: Size of each half of the memory that a Python worker has of words it has encoded.
KEPT = 400_000
#: A text longer than this is encoded in parts, cut at white space.
PART = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, free = {}, 256
    for b in range(256):
        letters[b] = chr(b if b in plain else free)
        free += b not in plain
    return [letters[b] for b in range(256)]


def pack(ids: Iterable[int]) -> bytes:
    return np.asarray(ids, "<i4").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<i4")


def ranges(letters: list[str]) -> str:
    """Sorted letters as ranges of a character class."""
    codes = np.array([ord(c) for c in letters], int)
    groups = np.split(codes, np.flatnonzero(np.diff(codes) != 1) + 1) if len(codes) else []
    return "".join(rf"\U{g[0]:08x}-\U{g[-1]:08x}" for g in groups)


class Lookup:
    """Positions of integer keys by open addressing, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = int(len(keys) * 4).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.at = np.full(1 << bits, -1), np.zeros(1 << bits, np.int64)
        waiting = np.arange(len(keys))
        slot = self._slot(keys)
        while len(waiting):
            free = self.slots[slot] < 0
            self.at[slot[free]] = waiting[free]
            self.slots[slot[free]] = keys[waiting[free]]
            lost = self.slots[slot] != keys[waiting]
            waiting, slot = waiting[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 if there is none."""
        slot = self._slot(keys)
        seen = self.slots[slot]
        out = np.where(seen == keys, self.at[slot], -1)
        live = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(live):
            slot[live] = (slot[live] + 1) & self.mask
            seen = self.slots[slot[live]]
            hit = seen == keys[live]
            out[live[hit]] = self.at[slot[live[hit]]]
            live = live[~hit & (seen >= 0)]
        return out


class Bpe:
    """A vocabulary with word ends, read from a tokenizer file.

    Symbols are bytes; the last byte of a word counts as another symbol (256 + byte). Tokens are
    numbered as in the file; ``left``, ``right`` and ``rank`` tell from which rule a token comes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_of = regex.compile(pattern + r"|\n").findall
        # Letters that the tables of the tokenizers library do not have yet count as other signs there.
        self.lower = normalizers.Lowercase().normalize_str
        doubtful = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, range(0x80, 0x110000)))) if unicodedata.category(c) == "Cn")
        settled = set(normalizers.Replace(Regex(r"[^\p{L}\p{N}]"), "").normalize_str(doubtful))
        newer = ranges(sorted(set(doubtful) - settled)) or r"\x00"
        self.first_doubtful, self.doubtful = min(map(ord, doubtful)), re.compile(f"[{ranges(sorted(doubtful))}]")
        letter, digit = rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]"
        careful = pattern.replace(r"[^\s\p{L}\p{N}]+", rf"(?:(?!{letter}|{digit})\S)+").replace(r"[\p{L}]+", letter + "+").replace(r"[\p{N}]", digit)
        self.careful_words_of = regex.compile(careful + r"|\n", regex.V1).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.size = n = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * n
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.base = np.array([vocab[c] for c in byte_letters()] + [vocab[c + end] for c in byte_letters()])
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        symbols: dict[int, tuple[int, ...]] = {int(t): (s,) for s, t in enumerate(self.base)}
        rule: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            rule[x, y] = t
            if t not in symbols:
                self.left[t], self.right[t], self.rank[t] = x, y, r
                symbols[t] = symbols[x] + symbols[y]
        keys, made = np.array([x * n + y for x, y in rule]), np.array(list(rule.values()))
        self.never = len(self.rank) + len(keys)
        self.pair, self.pair_tokens, self.pair_ranks = Lookup(keys), made, np.r_[self.rank[made], self.never]
        self._build_trie(symbols)
        self.sound = self._sound()

    def _build_trie(self, symbols: dict[int, tuple[int, ...]]) -> None:
        """Edges of the prefix tree under keys (node * 512 + symbol), so that many words step at once."""
        edges: dict[int, int] = {}
        token = [-1]
        for t, seq in symbols.items():
            node = 0
            for s in seq:
                node = edges.setdefault(node * 512 + s, len(edges) + 1)
                if node == len(token):
                    token.append(-1)
            token[node] = t
        self.edge, self.edge_to, self.node_token = Lookup(np.array(list(edges))), np.array(list(edges.values())), np.array(token)

    def grow_together(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """For each pair: would merging the text of both apply a rule across the border?

        Both sides are undone step by step, the younger piece first, and each pair of pieces that
        lay side by side is looked up. A rule applies if it comes before the one that ended the
        left piece, and not after the one that ended the right piece (of equal rules the leftmost
        goes first). ``inner`` leaves the whole pair itself out.
        """
        a, b = a.copy(), b.copy()
        never = self.never
        a_until, b_until = np.full(len(a), never), np.full(len(a), never)
        crossed = np.zeros(len(a), bool)
        live, first = np.arange(len(a)), inner
        while len(live):
            x, y = a[live], b[live]
            r = self.pair_ranks[self.pair(x * self.size + y)]
            hit = (r < a_until[live]) & (r <= b_until[live]) & (r < never)
            if first:
                hit[:] = False
                first = False
            crossed[live[hit]] = True
            x_rank, y_rank = self.rank[x], self.rank[y]
            undo_left = x_rank > y_rank
            go = live[undo_left]
            a_until[go], a[go] = x_rank[undo_left], self.right[x[undo_left]]
            go = live[~undo_left]
            b_until[go], b[go] = y_rank[~undo_left], self.left[y[~undo_left]]
            live = live[~hit & (np.maximum(x_rank, y_rank) >= 0)]
        return crossed

    def _sound(self) -> np.ndarray:
        """Tokens that merging their own text gives back."""
        made = np.flatnonzero(self.rank >= 0)
        sound = np.zeros(self.size, bool)
        sound[self.base] = True
        own = np.zeros(self.size, bool)
        own[made] = ~self.grow_together(self.left[made], self.right[made], inner=True)
        for t in made[np.argsort(self.rank[made])]:
            sound[t] = own[t] and sound[self.left[t]] and sound[self.right[t]]
        return sound

    def longest_matches(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy tokens of many words: (word number, token), in word order."""
        at, words, who, what = start.copy(), np.arange(len(start)), [], []
        while len(words):
            node, p, live = np.zeros(len(words), np.int64), at[words].copy(), np.arange(len(words))
            token, stop = np.full(len(words), -1), p.copy()
            while len(live):
                i = self.edge(node[live] * 512 + symbols[p[live]])
                found = i >= 0
                live, to = live[found], self.edge_to[i[found]]
                node[live] = to
                p[live] += 1
                known = self.node_token[to]
                ends = known >= 0
                token[live[ends]], stop[live[ends]] = known[ends], p[live[ends]]
                live = live[p[live] < end[words[live]]]
            who.append(words)
            what.append(token)
            at[words] = stop
            words = words[stop < end[words]]
        who, what = np.concatenate(who), np.concatenate(what)
        by = np.argsort(who, kind="stable")
        return who[by], what[by]

    def merged(self, token: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Exact merging of many words at once: in each step every word applies its earliest rule at all its places.

        Rules that use a new token come after the one that made it, so the places of one rule never
        change each other; of places that overlap every second one from the left counts. Yields
        (word number, tokens) of the words that are finished.
        """
        never = self.never
        while len(token):
            at = self.pair(token[:-1] * self.size + token[1:])
            rank = np.full(len(token), never)
            rank[:-1] = np.where(who[1:] == who[:-1], self.pair_ranks[at], never)
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(token)]))
            done = least == never
            yield who[done], token[done]
            place = np.flatnonzero((rank == least) & ~done)
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(place) != 1], np.arange(len(place)), 0)) if len(place) else place
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            token[place] = self.pair_tokens[at[place]]
            keep = ~done
            keep[place + 1] = False
            token, who = token[keep], who[keep]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Tokens of normalised words that are not empty, as packed little-endian 32-bit numbers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        end = np.cumsum([len(r) for r in raw])
        start = np.concatenate([[0], end[:-1]])
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[end - 1] += 256
        who, token = self.longest_matches(symbols, start, end)
        wrong = np.zeros(len(words), bool)
        wrong[who[~self.sound[token]]] = True
        side = np.flatnonzero(who[1:] == who[:-1])
        pairs, which = np.unique(token[side] * self.size + token[side + 1], return_inverse=True)
        wrong[who[side[self.grow_together(pairs // self.size, pairs % self.size)[which]]]] = True
        bounds = (np.searchsorted(who, np.arange(len(words) + 1)) * 4).tolist()
        flat = token.astype("<i4").tobytes()
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        again = np.repeat(wrong, end - start)
        for number, tokens in self.merged(self.base[symbols[again]], np.repeat(np.arange(len(words)), end - start)[again]):
            ends = np.flatnonzero(np.r_[number[1:] != number[:-1], True])[: len(number)] + 1
            flat = tokens.astype("<i4").tobytes()
            for i, a, b in zip(number[ends - 1].tolist(), [0, *(ends[:-1] * 4).tolist()], (ends * 4).tolist()):
                out[i] = flat[a:b]
        return out

    @staticmethod
    def normalised(text: str) -> str:
        """Composed and lower-cased letter by letter, so a final sigma is not told apart."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def cut(self, chunks: list[str]) -> list[str]:
        """Words of normalised texts without white space, a line break after those of each text."""
        text = "\n".join([*chunks, ""])
        if text.isascii() or not (np.frombuffer(text.encode("utf-32-le"), np.uint32) >= self.first_doubtful).any() or not self.doubtful.search(text):
            return self.words_of(self.normalised(text))
        return self.careful_words_of(self.lower(unicodedata.normalize("NFC", text)))

    def learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Packed tokens of texts without white space."""
        chunks = list(chunks)
        plain = [c for c in chunks if "<|" not in c]
        parts = {c: self.specials.split(c) for c in chunks if "<|" in c}
        plain += {p for ps in parts.values() for p in ps[::2] if p}
        words = self.cut(plain)
        ids = dict.fromkeys(words)
        ids.pop("\n", None)
        ids = dict(zip(ids, self.encode_words(list(ids))))
        known, held, each = {}, b"", iter(plain)
        for w in words:
            if w == "\n":
                known[next(each)] = held
                held = b""
            else:
                held += ids[w]
        for c, ps in parts.items():
            known[c] = b"".join(pack([self.special[p]]) if i % 2 else known.get(p, b"") for i, p in enumerate(ps))
        return known

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings with one space between: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


@cache
def bpe(path: str) -> Bpe:
    """One vocabulary per Python worker."""
    return Bpe(path)


class Memory:
    """Values of texts seen before: a young and an old half, so that common texts stay and memory is bounded.

    A Python worker lives through many stages; only the memory used last holds anything.
    """

    used: Memory | None = None

    def __init__(self, learn, limit: int):
        self.learn, self.limit, self.young, self.old = learn, limit, {}, {}

    def of(self, chunks: set[str]) -> dict:
        """A table that holds all the given texts, valid until the next call of any memory."""
        if Memory.used is not self:
            if Memory.used is not None:
                Memory.used.young, Memory.used.old = {}, {}
            Memory.used = self
        new = chunks.difference(self.young)
        if len(self.young) + len(new) > self.limit:
            self.young, self.old = {}, self.young
            new = chunks
        old = self.old
        self.young.update({c: old[c] for c in new if c in old})
        new = new.difference(old)
        if new:
            self.young.update(self.learn(new))
        return self.young


@cache
def memory(path: str) -> Memory:
    return Memory(bpe(path).learn, KEPT)


def parts_of(text: str, limit: int = PART) -> Iterator[str]:
    """The text in parts of about ``limit`` characters, cut where white space begins; a part without any stays whole."""
    start = 0
    while len(text) - start > limit:
        space = regex.compile(r"\s").search(text, start + limit)
        if space is None:
            break
        yield text[start : space.start()]
        start = space.start()
    yield text[start:] if start else text


def chunks_of(text: str) -> list[str]:
    """The text cut at white space. Four control characters that Python takes for white space are none here."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return re.findall(r"[\S\x1c-\x1f]+", text)
    return text.split()


def encoded(texts: list[str], path: str) -> Iterator[bytes]:
    """Packed tokens of each text; every different chunk of all texts is looked up once, and new ones are encoded together.

    Cut at ASCII white space only; the tokenizer drops any other inside a chunk.
    """
    cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    chunks = pc.list_flatten(cut).dictionary_encode()
    different = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
    known = memory(path).of(set(different))
    packed = pa.array(list(map(known.__getitem__, different)), pa.large_binary()).take(chunks.indices)
    _, ends, data = packed.buffers()
    at = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()].tolist() if len(packed) else [0] * (len(texts) + 1)
    for a, b in zip(at, at[1:]):
        yield data[a:b].to_pybytes() if b > a else b""


def encoded_parts(texts: list[str], path: str) -> Iterator[Iterator[bytes]]:
    """For each text its packed tokens, in parts if the text is long."""
    short = encoded([t for t in texts if len(t) <= PART], path)
    for text in texts:
        yield iter((next(short),)) if len(text) <= PART else (next(encoded([p], path)) for p in parts_of(text))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's token ids: the id column and ``ids array<int>``.

    A missing or empty text has no tokens; rows that repeat are encoded each. No shuffle; other
    columns are not read.
    """
    on_workers(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            ids = [unpack(b"".join(parts)) for parts in encoded_parts(batch.column(1).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_column, "ids"])

    return texts_of(docs, id_column, text=text).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of token ids: the id column and ``text``. Missing ids give an empty text."""
    on_workers(tokens.sparkSession)
    kind = tokens.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            texts = [model.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return tokens.select(id_column, ids).mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The tokens of a text live in memory for one part of it at a time, whatever its length.
    A missing text counts as empty: no tokens, both digests those of the empty string.
    """
    on_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        digits = [str(i) for i in range(model.size)]
        for batch in pieces_of(batches, "text"):
            count, ids_sha, text_sha = [], [], []
            for parts in encoded_parts(batch.column(1).to_pylist(), path):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for ids in (unpack(p).tolist() for p in parts if p):
                    gap = " " if n else ""
                    n += len(ids)
                    a.update((gap + " ".join(map(digits.__getitem__, ids))).encode())
                    b.update((gap + model.decode(ids)).encode())
                count.append(n)
                ids_sha.append(a.hexdigest())
                text_sha.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts_of(docs, "doc_id").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
