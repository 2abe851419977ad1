"""Ids of texts by the byte-level BPE tokenizer of op7: the distinct words of many texts are merged at once in numpy."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

#: Words of more bytes than this, and runs with characters that normalising may change, are left to the tokenizer itself.
LONG = 64
#: Runs left to the tokenizer whose ids a worker remembers.
CACHE = 200_000
#: Runs whose ids are gathered at once, and distinct runs that are split and merged at once.
STEP, DISTINCT = 1_000_000, 250_000

#: What a tokenizer's file must say for its words to be merged here; others encode whole texts themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: The rank of two tokens that never merge.
NEVER = 1 << 24


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters below U+0300: class, lower case, and whether their lower case is one character of as many bytes. None of them
    composes with another, so normalising leaves them as they are."""
    kind, lower, plain = np.full(0x300, OTHER, np.uint8), np.arange(0x300), np.ones(0x300, bool)
    for c in range(0x300):
        kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
        low = chr(c).lower()
        plain[c] = len(low) == 1 and len(low.encode()) == len(chr(c).encode()) and not (c < 32 or 127 <= c <= 160)
        lower[c] = ord(low) if plain[c] else c
    kind[32] = SPACE
    return kind, lower, plain


KIND, LOWER, PLAIN = _tables()
#: Whether a byte may stand in a run that isn't left to the tokenizer.
PLAIN_BYTE = np.concatenate([PLAIN[:128], np.arange(128, 256) < 0xCC])


def known_steps(spec: dict) -> bool:
    model = spec["model"]
    flags = model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(f) for f in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    added = all("<|" in t["content"] and not set(" \n") & set(t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    return bool(flags) and added and all(spec.get(k) == v for k, v in STEPS.items())


def slices(data, offsets: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def content(array: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of all spans one after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Merges:
    """The merges of a byte-level BPE model: in every word the pair of the lowest rank first, of equal ones the leftmost."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # Byte-level vocabularies write a byte that doesn't print as the next free character from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[names[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        n = max(vocab.values()) + 1
        self.kind, width = (np.uint32, 32) if n * n < 1 << 32 else (np.uint64, 64)
        self.n, self.none = self.kind(n), np.iinfo(self.kind).max
        key = np.array([vocab[a] for a, _ in pairs], self.kind) * self.n + np.array([vocab[b] for _, b in pairs], self.kind)
        # Hash tables without collisions: each takes the first key of every slot and leaves the others to the next one.
        self.levels, rank, rng = [], np.arange(len(key), dtype=np.int32), np.random.default_rng(0)
        while len(key):
            bits = max(10, len(key).bit_length() + 2)
            odd, shift = self.kind(int(rng.integers(1 << (width - 2))) * 2 + 1), self.kind(width - bits)
            slot, k = np.unique((key * odd) >> shift, return_index=True)
            keys, ranks = np.full(1 << bits, self.none, self.kind), np.full(1 << bits, NEVER, np.int32)
            keys[slot], ranks[slot] = key[k], rank[k]
            self.levels.append((odd, shift, keys, ranks))
            key, rank = np.delete(key, k), np.delete(rank, k)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(self.kind) * self.n + b.astype(self.kind)).ravel()
        out, todo = np.full(len(key), NEVER, np.int32), slice(None)
        for odd, shift, keys, ranks in self.levels:
            slot = (key * odd) >> shift
            found = keys[slot]
            hit = found == key
            out[todo] = np.where(hit, ranks[slot], NEVER)
            # Only a key whose slot is taken by another one may be in the next table.
            more = np.flatnonzero(~hit & (found != self.none))
            todo, key = more if isinstance(todo, slice) else todo[more], key[more]
        return out.reshape(a.shape)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its first place in the ids, its number of ids; and the ids. No word is empty or longer than LONG.

        Every round merges one pair of each word that still has one; words of as many tokens form one matrix, a column each, so
        that a word which has merged joins the next shorter ones."""
        length = np.diff(offsets)
        first, size, ids, total = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), [], 0
        by_length = np.argsort(length, kind="stable")
        starts = np.searchsorted(length[by_length], np.arange(LONG + 2))
        longest = int(length.max(initial=0))
        who, s, r = np.zeros(0, np.int64), np.zeros((longest, 0), np.int32), np.zeros((max(longest - 1, 0), 0), np.int32)
        for m in range(longest, 0, -1):
            new = by_length[starts[m] : starts[m + 1]]
            if len(new):
                b = data[offsets[new] + np.arange(m)[:, None]]
                t = self.inner[b]
                t[-1] = self.last[b[-1]]
                who, s, r = np.concatenate([who, new]), np.concatenate([s, t], 1), np.concatenate([r, self.rank(t[:-1], t[1:])], 1)
            row = np.arange(m - 1, dtype=np.int32)[:, None]
            # Rank and place in one number: its least is the leftmost of the lowest.
            low = ((r << 6) | row).min(0) if m > 1 else np.full(len(who), NEVER << 6, np.int32)
            over = low >= NEVER << 6
            if over.any():
                done = who[over]
                first[done], size[done] = total + m * np.arange(len(done)), m
                ids.append(s[:, over].T.ravel())
                total += m * len(done)
                go = ~over
                who, s, r, low = who[go], s[:, go], r[:, go], low[go]
            if m == 1:
                break
            p, made, col = low & 63, self.made[low >> 6], np.arange(len(who))
            s = np.where(row <= p, s[:-1], s[1:])
            s[p, col] = made
            r = np.where(row[:-1] < p, r[:-1], r[1:])
            at = np.flatnonzero(p > 0)
            r[p[at] - 1, at] = self.rank(s[p[at] - 1, at], made[at])
            at = np.flatnonzero(p < m - 2)
            r[p[at], at] = self.rank(made[at], s[p[at] + 1, at])
        return first, size, np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.uint32)


class Tokens:
    """Ids of whole texts. The tokenizer never joins across a space or a line feed, so each distinct run between them is
    encoded once for many texts. Runs are split into words as its pattern does (contractions; letters; single digits; others)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"]) if known_steps(spec) else None
        self.clear()

    def clear(self):
        self.index: dict[bytes, np.ndarray] = {}

    def _left(self, runs: list[bytes]) -> list[np.ndarray]:
        """Ids of runs by the tokenizer itself."""
        known = {r: self.index[r] for r in runs if r in self.index}
        new = [r for r in runs if r not in known]
        if new:
            # One call for all of them: the tokens' places in the joined text tell whose they are.
            texts = [r.decode() for r in new]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            begin = np.cumsum([0, *(len(r) + 1 for r in texts[:-1])])
            size = np.bincount(np.searchsorted(begin, [a for a, _ in got.offsets], "right") - 1, minlength=len(new))
            known |= zip(new, np.split(np.array(got.ids, np.uint32), np.cumsum(size)[:-1]))
            if len(self.index) > CACHE:
                self.clear()
            self.index |= {r: known[r].copy() for r in new if len(r) <= LONG}
        return [known[r] for r in runs]

    def _runs(self, runs: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run, which ends with a space, the first place in the ids and their number; and the ids."""
        raw, offsets = content(runs)
        odd = ~PLAIN_BYTE[raw]
        odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))  # special tokens
        small = raw < 128
        b, kind = np.where(small, LOWER.astype(np.uint8)[raw & 127], raw), KIND[raw & 127]
        two = np.flatnonzero((raw >= 0xC0) & ~odd)
        c = (raw[two] & 31).astype(np.int64) << 6 | raw[two + 1] & 63
        odd[two] = ~PLAIN[c]
        kind[two] = kind[two + 1] = KIND[c]
        b[two], b[two + 1] = 0xC0 | LOWER[c] >> 6, 0x80 | LOWER[c] & 63
        start = np.ones(len(b), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start[offsets[:-1]] = True
        start[two + 1] = False
        quote = np.flatnonzero((b == ord("'")) & start)
        after, then = b[quote + 1], b[np.minimum(quote + 2, len(b) - 1)]
        one = quote[np.isin(after, np.frombuffer(b"stmd", np.uint8))]
        start[one + 1], start[one + 2] = False, True
        more = quote[((after == ord("r")) | (after == ord("v"))) & (then == ord("e")) | (after == ord("l")) & (then == ord("l"))]
        start[more + 1], start[more + 3] = False, True
        begin = np.flatnonzero(start)
        ends = np.append(begin[1:], len(b))
        head = np.zeros(len(b), np.int32)
        head[offsets[1:-1]] = 1
        of = np.cumsum(head)[begin]
        left = np.logical_or.reduceat(odd, offsets[:-1])
        left[of[ends - begin > LONG]] = True
        keep = (b[begin] != 32) & ~left[of]
        words = slices(b, np.append(begin, len(b))).filter(pa.array(keep)).dictionary_encode()
        f, n, ids = self.merges.words(*content(words.dictionary))
        at = words.indices.to_numpy()
        ids = ids[spans(f[at], n[at])]
        size = np.bincount(of[keep], n[at], len(runs)).astype(np.int64)
        first = np.cumsum(size) - size
        if left.any():
            which = np.flatnonzero(left)
            got = self._left([r[:-1] for r in runs.take(pa.array(which)).to_pylist()])
            size[which] = [len(g) for g in got]
            first[which] = len(ids) + np.cumsum(size[which]) - size[which]
            ids = np.concatenate([ids, *got])
        return first, size, ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if self.merges is None:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        raw = [t.encode() for t in texts]
        data = b" ".join([*raw, b""]).replace(b"\n", b" ")
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
        runs = slices(data, np.append(0, ends)).dictionary_encode()
        first, size, ids = zip(*(self._runs(runs.dictionary[k : k + DISTINCT]) for k in range(0, len(runs.dictionary), DISTINCT)))
        first = np.concatenate([f + b for f, b in zip(first, np.cumsum([0, *map(len, ids)]))])
        size, ids = np.concatenate(size), np.concatenate(ids)
        at = runs.indices.to_numpy()
        flat = np.concatenate([ids[spans(first[x], size[x])] for x in np.split(at, range(STEP, len(at), STEP))])
        # A text ends with its own space.
        last = np.cumsum([len(r) + 1 for r in raw])
        cuts = np.append(0, np.cumsum(size[at])[np.searchsorted(ends, last)])
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
