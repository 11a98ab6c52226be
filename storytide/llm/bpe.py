"""Byte-pair encoding of blocks of texts.

`ByteBPE` speculates and verifies: a greedy longest match proposes the tokens
of each new word, numpy tests every adjacent pair of all proposals for
compatibility, and only the words with an incompatible pair go through exact
merging. A proposal whose pairs are all compatible is the merge result, since
no merge can ever cross one of its borders.

`WordBPE` merges the words of a word-level vocabulary exactly, many at a time.
Both keep a table of the words they have met, so running text costs one lookup a word.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

import numpy as np
import pandas as pd

from . import textvec as tv

#: Words and letters of a worker's word table before it is begun anew.
TABLE_WORDS, TABLE_LETTERS = 150_000, 1 << 21


def tokenizer_file(name: str) -> str:
    """The place of a tokenizer: a path, or the name of a file of the public_tokenizers package."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library_tokenizer(name: str):
    """The library's tokenizer with truncation and padding unused."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Table:
    """Words -> token ids, in flat arrays. Words are found by hash and compared letter by letter."""

    def __init__(self) -> None:
        self.index, self.n = tv.HashIndex(1 << 16), 0
        self.ids, self.letters = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
        self.start, self.length, self.word, self.size = (np.zeros(1 << 14, np.int64) for _ in range(4))
        self.used = self.spelled = 0

    def put(self, ids: np.ndarray, lens: np.ndarray, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The new entries of words, given their ids and letters in a row and how many each has."""
        k, n = self.n, len(lens)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.spelled + len(letters) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        while k + n > len(self.start):
            self.start, self.length, self.word, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.word, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.letters[self.spelled : self.spelled + len(letters)] = letters
        self.length[k : k + n], self.size[k : k + n] = lens, sizes
        self.start[k : k + n] = self.used + np.cumsum(lens) - lens
        self.word[k : k + n] = self.spelled + np.cumsum(sizes) - sizes
        self.used, self.spelled, self.n = self.used + len(ids), self.spelled + len(letters), k + n
        return np.arange(k, k + n)

    def unlike(self, entry: np.ndarray, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places of the spans that are other words than their entries."""
        sizes = ends - starts
        same = self.size[entry] == sizes
        on = np.flatnonzero(same)
        sizes, first = sizes[on], starts[on]
        whole = len(on) and len(on) == len(starts) and ends[-1] - starts[0] == sizes.sum()
        text = cp[starts[0] : ends[-1]] if whole else cp[tv.ragged(first, sizes)]
        differ = self.letters[tv.ragged(self.word[entry[on]], sizes)] != text
        if differ.any():
            same[on[np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)]] = False
        return np.flatnonzero(~same)


class Merges:
    """Exact byte-pair merging of many words at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        self.left, self.right, self.made = left, right, made
        self.index = tv.HashIndex(1 << 18)
        self.index.add(self.key(left, right), np.arange(len(left)))
        self.none = len(left)

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)) + np.uint64(1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges, or the number of merges."""
        r = self.index.get(self.key(a, b))
        r[r < 0] = self.none
        return r

    def run(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each word's pieces, the lowest-ranked pair first, the leftmost of equals.

        ids, lens: the pieces of all words in a row, and how many each word has (one at least).
        In each round every unfinished word makes one merge; only pairs at the merge are looked up anew.
        """
        words = np.arange(len(lens))
        ids, ends = ids.astype(np.int64), np.cumsum(lens)
        rank = np.full(len(ids), self.none, np.int64)
        inner = np.ones(len(ids), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.rank(ids[at], ids[at + 1])
        done_ids, done_words, done_lens = [], [], []
        while len(words):
            starts = ends - lens
            least = np.minimum.reduceat(rank, starts)
            over = least == self.none
            if over.any():
                gone = np.repeat(over, lens)
                done_ids.append(ids[gone])
                done_words.append(words[over])
                done_lens.append(lens[over])
                ids, rank, words, lens, least = ids[~gone], rank[~gone], words[~over], lens[~over], least[~over]
                ends = np.cumsum(lens)
                if not len(words):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, lens))
            at = hits[np.searchsorted(hits, ends - lens)]  # the leftmost of each word
            ids[at] = self.made[least]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]
            ids, rank = ids[keep], rank[keep]
            at -= np.arange(len(at))
            lens = lens - 1
            ends = np.cumsum(lens)
            has = at[at < ends - 1]
            rank[has] = self.rank(ids[has], ids[has + 1])
            has = at[at > ends - lens]
            rank[has - 1] = self.rank(ids[has - 1], ids[has])
        words, lens = np.concatenate(done_words), np.concatenate(done_lens)
        order = np.argsort(words)
        flat = np.concatenate(done_ids)
        starts = np.cumsum(lens) - lens
        return flat[tv.ragged(starts[order], lens[order])].astype(np.uint32), lens[order]


class _Encoder:
    """Encodes texts word by word with a table of known words."""

    #: Words and letters of the table before it is begun anew.
    most = (TABLE_WORDS, TABLE_LETTERS)

    def __init__(self, name: str) -> None:
        self.name = name
        self.table = _Table()
        spec = json.loads(open(tokenizer_file(name), encoding="utf-8").read())
        added = spec.get("added_tokens") or []
        if any(x.get(flag) for x in added for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("only added tokens that are matched as they stand are supported")
        self.added = {x["content"]: x["id"] for x in added}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.setup(spec)

    def setup(self, spec: dict) -> None:
        pass

    def normal(self, text: str) -> str:
        return text

    def spans(self, cp: np.ndarray, off: np.ndarray):
        raise NotImplementedError

    def hashes(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return tv.word_hashes(cp, starts, ends)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode(self, texts: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, n + 1 offsets). Added tokens are matched first; what stands between them is
        encoded apart. plain: the strings of added tokens are ordinary text."""
        parts, owner, after = [], [], []
        for k, t in enumerate(texts):
            own = self.cut.split(t) if not plain and any(x in t for x in self.added) else [t]
            parts += map(self.normal, own[::2])
            owner += [k] * (len(own) // 2 + 1)
            after += [*(self.added[x] for x in own[1::2]), -1]
        ids, lens = [np.empty(0, np.uint32)], np.zeros(len(parts), np.int64)
        for a, b in tv.blocks(parts):
            part, off = self._block(parts[a:b])
            lens[a:b] = np.diff(off)
            ids.append(part)
        flat, after = np.concatenate(ids), np.array(after, np.int64)
        if (after >= 0).any():
            flat = np.insert(flat, np.cumsum(lens)[after >= 0], after[after >= 0])
        off = np.zeros(len(texts) + 1, np.int64)
        np.add.at(off, np.array(owner, np.int64) + 1, lens + (after >= 0))
        return flat, np.cumsum(off)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        cp, off = tv.codepoints(texts)
        if not len(cp):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts, ends = self.spans(cp, off)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if self.table.n > self.most[0] or self.table.spelled > self.most[1]:
            self.table = _Table()
        t, keys = self.table, self.hashes(cp, starts, ends)

        def put(at: np.ndarray) -> np.ndarray:
            sizes = ends[at] - starts[at]
            return t.put(*self.words([whole[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]), cp[tv.ragged(starts[at], sizes)], sizes)

        entry = t.index.get(keys)
        new = np.flatnonzero(entry < 0)
        if len(new):
            codes, uniq = pd.factorize(keys[new])
            fresh = put(new[tv.first_seen(codes, len(uniq))])
            t.index.add(uniq, fresh)
            entry[new] = fresh[codes]
        other = t.unlike(entry, cp, starts, ends)
        if len(other):  # words whose hash is another word's
            entry[other] = put(other)
        lens = t.length[entry]
        total = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=total[1:])
        return t.ids[tv.ragged(t.start[entry], lens)], total[np.searchsorted(starts, off)]


def byte_pieces(words: list[str], inner: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words as ids, and their numbers; `last` has the ids of bytes that end a word."""
    raw = [w.encode() for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    ids = inner[flat]
    if last is not None:
        ends = np.cumsum(lens) - 1
        ids[ends] = last[flat[ends]]
    return ids, lens


class WordBPE(_Encoder):
    """Word-level BPE with lower-cased, NFC-normalised words."""

    def setup(self, spec):
        vocab, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        ids = [np.array([vocab[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1])]
        self.merges = Merges(*ids)
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, byte in byte_alphabet().items():
            self.inner[byte], self.last[byte] = vocab[c], vocab[c + mark]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() looks at a final sigma's neighbours, the tokenizer doesn't
                return "".join(c.lower() for c in text)
        return text.lower()

    def spans(self, cp, off):
        return tv.split_words(cp, off)

    def words(self, words):
        return self.merges.run(*byte_pieces(words, self.inner, self.last))


class ByteBPE(_Encoder):
    """Byte-level BPE by speculation and verification, and its decoder."""

    def setup(self, spec: dict) -> None:
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        size = max([*vocab.values(), *(x["id"] for x in spec.get("added_tokens") or [])]) + 1
        self.token = [b""] * size
        for s, i in vocab.items():
            self.token[i] = bytes(alphabet[c] for c in s)
        for x in spec.get("added_tokens") or []:
            self.token[x["id"]] = x["content"].encode()
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # ids in the order of the merges is what the pair test rests on
        self.base = int(made.min()) if len(made) else size
        if not np.array_equal(made, np.arange(self.base, self.base + len(made))) or max(len(self.token[i]) for i in range(self.base)) > 1:
            raise ValueError("token ids do not follow the order of the merges")
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.left[made], self.right[made] = left, right
        self.merges = Merges(left, right, made)
        self.byte = np.zeros(256, np.int64)
        self.byte[[self.token[i][0] for i in range(self.base)]] = np.arange(self.base)
        sound = np.ones(size, bool)
        sound[made] = self.compatible(left, right, made)  # a token that its own bytes never merge into can't be proposed
        self._plant([(self.token[i], i) for i in vocab.values() if sound[i]])
        lens = np.array([len(t) for t in self.token], np.int64)
        self.byte_len, self.byte_at = lens, np.cumsum(lens) - lens
        self.byte_flat = np.frombuffer(b"".join(self.token), np.uint8)
        shown = [b"%d," % i for i in range(size)]
        lens = np.array([len(t) for t in shown], np.int64)
        self.text_len, self.text_at, self.text_flat = lens, np.cumsum(lens) - lens, np.frombuffer(b"".join(shown), np.uint8)
        self.failed = self.seen = 0

    def spans(self, cp, off):
        return tv.split_bytes_bpe(cp, off)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge ever crosses the border between adjacent tokens a and b.

        Goes back in time along the two sides of the border: of the two pieces
        that touch it, the one formed later is split, and a merge of the two
        must not come before the merge that ended either.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40, np.int64) if limit is None else limit.astype(np.int64)
        ok, on = np.ones(len(a), bool), np.arange(len(a))
        while len(on):
            x, y = a[on], b[on]
            made = self.merges.rank(x, y) + self.base  # merge k makes token base + k
            crossed = (made < self.merges.none + self.base) & (made < limit[on])
            ok[on[crossed]] = False
            go = ~crossed & ((x >= self.base) | (y >= self.base))
            on, x, y = on[go], x[go], y[go]
            later = x > y
            limit[on] = np.where(later, x, y + 1)
            a[on] = np.where(later, self.right[x], x)
            b[on] = np.where(later, y, self.left[y])
        return ok

    def _plant(self, tokens: list[tuple[bytes, int]]) -> None:
        """A trie of the tokens: (node, byte) -> node; each node has its token, or -1."""
        nodes, ends = {}, [-1]
        for t, i in tokens:
            at = 0
            for c in t:
                key = (at << 8) | c
                if (to := nodes.get(key)) is None:
                    to = nodes[key] = len(ends)
                    ends.append(-1)
                at = to
            ends[at] = i
        self.trie = tv.HashIndex(1 << 18)
        self.trie.add(np.array(list(nodes), np.uint64) + np.uint64(1), np.array(list(nodes.values()), np.int64))
        self.ends = np.array(ends, np.int64)

    def propose(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words by greedy longest match, from their bytes in a row."""
        n, ends = len(data), np.cumsum(lens)
        stop = np.repeat(ends, lens)
        best, size = np.zeros(n, np.int64), np.ones(n, np.int64)
        on, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(on):  # from every place at once, one byte deeper each time
            node = self.trie.get(((node.astype(np.uint64) << np.uint64(8)) | data[on + depth]) + np.uint64(1))
            on, node = on[node >= 0], node[node >= 0]
            depth += 1
            token = self.ends[node]
            best[on[token >= 0]], size[on[token >= 0]] = token[token >= 0], depth
            more = on + depth < stop[on]
            on, node = on[more], node[more]
        taken = np.zeros(n, bool)
        at = ends - lens
        while len(at):
            taken[at] = True
            nxt = at + size[at]
            at = nxt[nxt < stop[at]]
        chosen = np.flatnonzero(taken)
        return best[chosen], np.diff(np.searchsorted(chosen, np.append(0, ends)))

    def words(self, words):
        base, n_bytes = byte_pieces(words, self.byte)
        data = np.frombuffer("".join(words).encode(), np.uint8)
        flat, lens = self.propose(data, n_bytes)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(lens) - 1] = False
        at = np.flatnonzero(inner)
        pair, back = np.unique((flat[at] << 32) | flat[at + 1], return_inverse=True)
        good = self.compatible(pair >> 32, pair & 0xFFFFFFFF)[back]
        bad = np.zeros(len(words), bool)
        bad[np.repeat(np.arange(len(words)), lens)[at[~good]]] = True
        self.seen += len(words)
        self.failed += int(bad.sum())
        if bad.any():
            right, n_right = self.merges.run(base[np.repeat(bad, n_bytes)], n_bytes[bad])
            flat, owner = flat[~np.repeat(bad, lens)], np.flatnonzero(~bad)
            both, n = np.concatenate([flat, right.astype(np.int64)]), np.concatenate([lens[~bad], n_right])
            order = np.argsort(np.concatenate([owner, np.flatnonzero(bad)]))
            flat, lens = both[tv.ragged((np.cumsum(n) - n)[order], n[order])], n[order]
        return flat.astype(np.uint32), lens

    def _gather(self, ids, off, flat, at, lens):
        n = lens[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        return flat[tv.ragged(at[ids], n)], total[off]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
        data, cut = self._gather(ids, off, self.byte_flat, self.byte_at, self.byte_len)
        data = data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def listed(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The decimal ids of each list, joined by commas."""
        data, cut = self._gather(ids, off, self.text_flat, self.text_at, self.text_len)
        data = data.tobytes()
        return [data[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


class PieceBPE(_Encoder):
    """Pieces of a sentencepiece model, which are merged by the library, one word at a time.

    A word is a run of blanks and what follows it up to the next blank. No piece goes on past a blank that follows
    another character, so no merge crosses a word's border, and the words' pieces are those of the whole text.
    Texts are given with the blank ahead that the model would add.
    """

    def __init__(self, name: str) -> None:
        import sentencepiece

        self.name, self.table, self.added, self.cut = name, _Table(), {}, None
        self.library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        shown = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(re.search("[^\u2581]\u2581", p) for p in shown):
            raise ValueError("pieces go past the end of a word")
        self.token = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(shown)]
        self.blank = self.library.piece_to_id("\u2581")
        lens = np.array([len(t) for t in self.token], np.int64)
        self.byte_len, self.byte_at = lens, np.cumsum(lens) - lens
        self.byte_flat = np.frombuffer(b"".join(self.token), np.uint8)

    def spans(self, cp, off):
        blank = cp == 32
        new = tv.text_starts(len(cp), off)
        new[1:] |= blank[1:] & ~blank[:-1]
        starts = np.flatnonzero(new)
        return starts, np.append(starts[1:], len(cp))

    def words(self, words):
        ids = self.library.encode([w[1:] for w in words], num_threads=1)
        ids = [x if x else [self.blank] for x in ids]  # the library adds no blank to an empty text
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum())), lens


@functools.cache
def word_encoder(name: str) -> WordBPE:
    return WordBPE(name)


@functools.cache
def byte_encoder(name: str) -> ByteBPE:
    return ByteBPE(name)
