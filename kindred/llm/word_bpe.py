"""Ids of whole texts from a word tokenizer: lower case, pre-tokens inside words, byte pairs with word ends.

A text is cut at ASCII white space.  Each word is resolved once and kept by its 64-bit hash in tables of fixed
size.  New words are resolved together, as arrays: letters are lowered and cut into pre-tokens by tables of
character classes, and the pairs of lowest rank of all pre-tokens are merged round by round.  Words of other
scripts, with special tokens, spaces beyond ASCII or more than LONG_WORD bytes go through the library, as does
every word where the tokenizer's settings aren't those this module knows.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex
import xxhash

from .common import U, buffers, gather, mix, pieces, span_hashes, spans

TABLE_BITS = 20
ARENA_IDS = 1 << 22
LONG_WORD = 64
_EMPTY = U(0)
_NEVER = np.iinfo(np.int32).max

# The pattern of the word tokenizer's own pre-tokens, its normalisers and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")


class HashTable:
    """Numbers of 64-bit hashes (never zero), by open addressing, for many at once."""

    def __init__(self, bits: int = TABLE_BITS):
        self.bits, self.most = bits, 1 << (bits - 1)
        self.key, self.slot = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.n = 0

    def clear(self) -> None:
        self.key[:] = 0
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number under which each hash was added, -1 for others."""
        at = (h >> U(64 - self.bits)).astype(np.int64)
        k = self.key[at]
        out = np.where(k == h, self.slot[at], np.int32(-1))
        rest = np.flatnonzero((k != h) & (k != _EMPTY))
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.bits) - 1)
            k = self.key[at]
            hit = k == h[rest]
            out[rest[hit]] = self.slot[at[hit]]
            go = ~hit & (k != _EMPTY)
            rest, at = rest[go], at[go]
        return out

    def add(self, h: np.ndarray) -> None:
        """New distinct hashes get the next numbers in order."""
        number = self.n + np.arange(len(h), dtype=np.int32)
        self.n += len(h)
        at = (h >> U(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.key[at] == _EMPTY
            self.key[at[free]] = h[free]
            won = self.key[at] == h
            self.slot[at[won]] = number[won]
            h, number, at = h[~won], number[~won], (at[~won] + 1) & ((1 << self.bits) - 1)


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it is visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Byte pair merges of many pre-tokens at once."""

    def __init__(self, model: dict):
        vocab, end, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + end] for x in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a, b = (np.array([vocab[p[i]] for p in pairs], np.uint64) for i in (0, 1))
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.table = HashTable(max(4, (4 * len(pairs)).bit_length()))
        self.table.add(self._key(a, b))
        # Merging all pairs of the lowest rank at once is the library's order if no merge makes a pair of lower rank.
        born = np.full(max(vocab.values()) + 1, -1)
        np.maximum.at(born, self.made, np.arange(len(pairs)))
        rank = np.arange(len(pairs))
        self.ordered = bool((born[a.astype(np.int64)] < rank).all() and (born[b.astype(np.int64)] < rank).all()) and len(set(pairs)) == len(pairs)

    @staticmethod
    def _key(a, b):
        return mix((a.astype(np.uint64) << U(32)) + b.astype(np.uint64) + U(1)) | U(1)

    def ids(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that begin at ``first`` and fill the text, and how many each has."""
        sym = self.inner[text]
        end = np.concatenate((first[1:], [len(text)])) - 1
        sym[end] = self.last[text[end]]
        of = np.repeat(np.arange(len(first)), np.diff(first, append=len(text)))
        out_sym, out_of = [], []
        while len(sym):
            rank = np.full(len(sym), _NEVER, np.int32)
            inside = np.flatnonzero(of[1:] == of[:-1])
            got = self.table.find(self._key(sym[inside], sym[inside + 1]))
            rank[inside[got >= 0]] = got[got >= 0]
            head = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, head), np.diff(head, append=len(sym)))
            done = best == _NEVER
            if done.any():
                out_sym.append(sym[done])
                out_of.append(of[done])
                sym, of, rank, best = sym[~done], of[~done], rank[~done], best[~done]
            hit = rank == best
            twice = np.flatnonzero(hit[1:] & hit[:-1] & (of[1:] == of[:-1])) + 1  # a run of equal symbols: every other pair
            if len(twice):
                at = np.flatnonzero(hit)
                run = np.concatenate(([True], (np.diff(at) > 1) | (of[at[1:]] != of[at[:-1]])))
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                hit[at[since % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, of = sym[stay], of[stay]
        sym, of = np.concatenate([sym, *out_sym]), np.concatenate([of, *out_of])
        return sym[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(first))


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size_of_vocabulary = self.tok.get_vocab_size()
        self.dtype = "<u2" if self.size_of_vocabulary <= 1 << 16 else "<u4"
        self.merges = self._known(json.loads(self.tok.to_str()))
        self._classes()
        self.words = HashTable()
        self.clear()

    @staticmethod
    def _known(spec: dict) -> Merges | None:
        cut, level = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}])[:2]
        norm = (spec["normalizer"] or {}).get("normalizers") or []
        model = spec["model"]
        same = [x["type"] for x in norm] == NORMALIZERS and norm[1]["pattern"] == {"Regex": r"\s+"} and cut.get("pattern") == {"Regex": PATTERN} and cut.get("invert")
        same = same and level.get("type") == "ByteLevel" and not level.get("use_regex") and not level.get("add_prefix_space") and all(x["content"].startswith("<|") for x in spec["added_tokens"])
        if not same or model["type"] != "BPE" or not model["end_of_word_suffix"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return None
        try:
            m = Merges(model)
        except KeyError:  # a byte without an entry
            return None
        return m if m.ordered else None

    def _classes(self) -> None:
        """Tables of the characters up to U+017F: 0 other, 1 letter, 2 number; lower case."""
        chars = [chr(c) for c in range(0x180)]
        self.kind = np.array([1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 0 for c in chars], np.uint8)
        self.lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.int32)
        # Bytes that send a word through the library: controls, and the leads of characters from U+0180 on.
        self.hard = np.zeros(256, bool)
        self.hard[[*range(32), 127, *range(0xC6, 256)]] = True

    def clear(self) -> None:
        self.words.clear()
        self.arena, self.first, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (an Arrow array) one behind the other, and where each text's begin and end."""
        data, offsets = buffers(texts)
        flat, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for i, j in pieces(offsets):
            part = data[offsets[i] : offsets[j]]
            s, e, doc = spans(part, offsets[i : j + 1] - offsets[i])
            h = span_hashes(part, s, e)
            for k in np.flatnonzero(e - s > LONG_WORD).tolist():
                h[k] = xxhash.xxh3_64_intdigest(part[s[k] : e[k]].tobytes())
            h[h == _EMPTY] = U(1)
            slot = self.words.find(h)
            new = np.flatnonzero(slot < 0)
            if len(new) and (self.words.n + len(new) > self.words.most or len(self.arena) > ARENA_IDS):
                self.clear()
                new = np.arange(len(h))
            if len(new):
                fresh, at = np.unique(h[new], return_index=True)
                if len(fresh) > self.words.most:
                    self.words = HashTable(len(fresh).bit_length() + 1)
                self.learn(part, s[new[at]], e[new[at]])
                self.words.add(fresh)
                slot[new] = self.words.find(h[new])
            n = self.size[slot]
            flat.append(gather(self.arena, self.first[slot], n))
            counts.append(np.bincount(doc, n, j - i).astype(np.int64))
        return np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    def learn(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Append the ids of the words data[s:e] to the arena."""
        size = e - s
        text = gather(data, s, size)
        if self.merges:
            then = np.concatenate((text[1:], [0])).astype(np.uint8)
            hard = self.hard[text] | ((text == 0xC2) & ((then == 0x85) | (then == 0xA0)))  # spaces beyond ASCII
            hard |= ((text == 0xC4) & (then == 0xB0)) | ((text == 0x3C) & (then == 0x7C))  # a letter that becomes two; special tokens
            easy = ~np.logical_or.reduceat(hard, np.cumsum(size) - size) & (size <= LONG_WORD)
        else:
            easy = np.zeros(len(s), bool)
        n = np.zeros(len(s), np.int64)
        at = np.flatnonzero(easy)
        found, n[at] = self._easy(text[np.repeat(easy, size)], size[at])
        parts, order = [found.astype(self.dtype)], [at]
        rest = np.flatnonzero(~easy)
        for i in range(0, len(rest), 1024):
            mine = rest[i : i + 1024]
            got = [np.array(x.ids, self.dtype) for x in self.tok.encode_batch_fast([data[s[k] : e[k]].tobytes().decode() for k in mine.tolist()], add_special_tokens=False)]
            n[mine] = [len(x) for x in got]
            parts += got
            order.append(mine)
        order = np.concatenate(order)
        first = np.empty(len(s), np.int64)
        first[order] = len(self.arena) + np.cumsum(n[order]) - n[order]
        self.first, self.size, self.arena = np.concatenate((self.first, first)), np.concatenate((self.size, n)), np.concatenate([self.arena, *parts])

    def _easy(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one behind the other, and how many each has."""
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        m = len(text)
        letter = text.astype(np.int32)
        lead = np.flatnonzero(text >= 0xC2)
        letter[lead] = ((letter[lead] & 0x1F) << 6) | (letter[lead + 1] & 0x3F)
        small = self.lower[np.minimum(letter, 0x17F)]
        kind = self.kind[np.minimum(letter, 0x17F)]
        low = small.astype(np.uint8)
        low[lead], low[lead + 1] = 0xC0 | (small[lead] >> 6), 0x80 | (small[lead] & 0x3F)
        kind[lead + 1] = kind[lead]
        start = (kind == 2) | np.concatenate(([True], kind[1:] != kind[:-1]))
        start[lead + 1] = False
        begin = np.cumsum(size) - size
        start[begin] = True
        left = np.repeat(begin + size, size) - np.arange(m)  # bytes to the end of the word
        quote = np.flatnonzero((low == 0x27) & start & (left > 1))
        if len(quote):
            b = low[quote + 1]
            one = np.isin(b, np.frombuffer(SHORT, np.uint8))
            two = np.zeros(len(quote), bool)
            c = low[np.minimum(quote + 2, m - 1)]
            for x, y in LONG:
                two |= (b == x) & (c == y) & (left[quote] > 2)
            start[quote[one | two] + 1] = False
            after = np.concatenate((quote[one] + 2, quote[two] + 3))
            inside = np.concatenate((left[quote[one]] > 2, left[quote[two]] > 3))
            start[after[inside]] = True
        first = np.flatnonzero(start)
        end = np.concatenate((first[1:], [m]))
        _, at, back = np.unique(span_hashes(low, first, end), return_index=True, return_inverse=True)
        width = (end - first)[at]
        found, n = self.merges.ids(gather(low, first[at], width), np.cumsum(width) - width)
        n_of = n[back]
        ids = gather(found, (np.cumsum(n) - n)[back], n_of)
        return ids, np.add.reduceat(n_of, np.searchsorted(first, begin))
