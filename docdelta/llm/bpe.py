"""Byte-pair encoding by speculation and verification, for tokenizer JSON files.

Greedy longest match proposes the tokens of every distinct word at once; a word stands if each of its
adjacent token pairs is compatible (merging the pair's text alone gives the pair back); only the words
with an incompatible pair are merged exactly. All tables are bounded by the vocabulary.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import regex
from tokenizers import Tokenizer

_NONE = np.int64(1 << 40)
#: Words of more symbols skip the speculation, whose steps are as many as the longest word's symbols.
LONG_WORD = 512
#: Distinct words kept between batches, and characters of text handled at a time.
CACHE_WORDS, CHUNK_CHARS = 600_000, 2_000_000
#: The White_Space property, as the tokenizers' regular expressions see it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Up to here every character is stable under NFC, and letters and numbers are listed below.
_PLAIN = 0x24F


def _ranges(kinds: str) -> str:
    found = [c for c in range(_PLAIN + 1) if unicodedata.category(chr(c))[0] in kinds]
    out, start = [], None
    for c, after in itertools.zip_longest(found, found[1:]):
        start = c if start is None else start
        if after != c + 1:
            out.append(f"\\u{start:04x}-\\u{c:04x}")
            start = None
    return "".join(out)


_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _word_patterns(kind: str) -> tuple[re.Pattern, regex.Pattern]:
    """The pre-tokenizer's pattern, for plain texts and for all."""

    def build(letter: str, number: str) -> str:
        if kind == "words":
            return f"{_CONTRACTIONS}|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+"
        return f"{_CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

    return re.compile(build(_ranges("L"), _ranges("N"))), regex.compile(build("\\p{L}", "\\p{N}"))


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@cache
def _unsure() -> re.Pattern:
    """Characters on whose kind Unicode versions differ: the library itself splits texts that have one."""
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    found, start = [], None
    for c in range(_PLAIN + 1, 0x110001):
        x = chr(c) if c < 0x110000 else "a"
        kind = unicodedata.category(x)
        odd = kind == "Cn" or bool(letter.match(x)) != (kind[0] == "L") or bool(number.match(x)) != (kind[0] == "N")
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            found.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile("[" + "".join(found) + "]")


class BpeModel:
    """The tables of one tokenizer file; picklable, so that it can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        spec = json.loads(self.source)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        if spec["model"]["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are read")
        self.kind = "words" if suffix else "spaced"
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.joined = spec["decoder"] is None
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        code = {c: b for b, c in enumerate(byte_alphabet())}
        self.shown = [""] * self.size
        self.raw = [b""] * self.size
        symbols: dict[int, list[int]] = {}
        for token, i in vocab.items():
            self.shown[i] = token
            if token in self.specials:
                continue
            ended = bool(suffix) and token.endswith(suffix)
            body = [code[c] for c in (token[: -len(suffix)] if ended else token)]
            self.raw[i] = bytes(body)
            symbols[i] = [*body[:-1], body[-1] + 256 * ended]
        for token, i in self.specials.items():
            self.shown[i], self.raw[i] = token, token.encode()
        self.base = np.full(512, -1, np.int64)
        for i, s in symbols.items():
            if len(s) == 1:
                self.base[s[0]] = i
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        keys = np.array([a * self.size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self._derive(symbols)

    def _derive(self, symbols: dict[int, list[int]]) -> None:
        """How each token comes about (parts and rank of its last merge), and a trie of those that merging reaches."""
        n = self.size
        self.born, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        steps: list[int] = []
        nodes: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, s in symbols.items():
            made: list[tuple[int, int, int]] = []
            if self.merge(s, made) != [i]:
                continue
            if made:
                self.born[i], self.left[i], self.right[i] = made[-1]
            node = 0
            for x in s:
                key = node * 512 + x
                if key not in nodes:
                    nodes[key] = len(nodes) + 1
                node = nodes[key]
            ends[node] = i
        for (a, b), (r, _) in self.merges.items():
            steps.append(r - max(self.born[a], self.born[b]))
        #: Whether a token's id tells its place among the merges, as rank encoders take for granted.
        made_ids = [i for _, i in self.merges.values()]
        self.ranked = made_ids == sorted(set(made_ids))
        #: A pair's verdict follows from its history only if parts are always older than what they make.
        self.proper = min(steps, default=1) > 0
        keys = np.fromiter(nodes.keys(), np.int64, len(nodes))
        order = np.argsort(keys)
        self.trie_keys, self.trie_to = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.trie_end = np.full(len(nodes) + 1, -1, np.int64)
        self.trie_end[list(ends)] = list(ends.values())

    def merge(self, symbols: Iterable[int], made: list | None = None) -> list[int]:
        """Exact merging: lowest rank first, leftmost first among equals."""
        ids = self.base[symbols].tolist()
        if len(ids) < 2:
            return ids
        if len(ids) <= 32 and made is None:
            return self._merge_short(ids)
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap = [(rule[0], k, rule[1]) for k in range(len(ids) - 1) if (rule := self.merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            r, k, t = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or self.merges.get((ids[k], ids[j])) != (r, t):
                continue
            if made is not None:
                made.append((r, ids[k], ids[j]))
            ids[k], ids[j], after[k] = t, -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if rule := self.merges.get((t, ids[after[k]])):
                    heapq.heappush(heap, (rule[0], k, rule[1]))
            if before[k] >= 0 and (rule := self.merges.get((ids[before[k]], t))):
                heapq.heappush(heap, (rule[0], before[k], rule[1]))
        return [i for i in ids if i >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same without a queue: the next merge is the least rule in a list of the present pairs'."""
        get, none = self.merges.get, (1 << 40, -1)
        rules = [get(pair, none) for pair in itertools.pairwise(ids)]
        while rules:
            best = min(rules)
            if best is none:
                break
            k = rules.index(best)
            ids[k : k + 2] = [best[1]]
            del rules[k]
            if k:
                rules[k - 1] = get((ids[k - 1], best[1]), none)
            if k < len(rules):
                rules[k] = get((best[1], ids[k + 1]), none)
        return ids


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts by a :class:`BpeModel`, with caches of words and of judged pairs."""

    def __init__(self, model: BpeModel):
        self.m = model
        self.plain, self.general = _word_patterns(model.kind)
        self.odd = re.compile(f"[^\\x00-\\u{_PLAIN:04x}]")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(model.specials, key=len, reverse=True))) + ")") if model.specials else None
        self.mark = os.path.commonprefix(list(model.specials))
        self.library = Tokenizer.from_str(model.source)
        self.space = re.compile(f"[{_SPACE}]+")
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.words_seen = self.words_merged = 0
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.offsets, self.counts, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    # -- words ---------------------------------------------------------------------------------------------
    def normal(self, text: str) -> str:
        if self.m.kind != "words":
            return text
        if self.odd.search(text):
            return self.library.normalizer.normalize_str(text)
        return self.space.sub(" ", text).lower()

    def is_unsure(self, text: str) -> bool:
        """Whether only the library knows how to split this text."""
        return bool(self.odd.search(text) and _unsure().search(text))

    def has_special(self, text: str) -> bool:
        """Whether one of the file's special tokens may stand in the text: what they all begin with does."""
        return self.special is not None and self.mark in text and bool(self.special.search(text))

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special token, text) in order."""
        if not self.has_special(text):
            yield False, text
            return
        for k, part in enumerate(self.special.split(text)):
            if part:
                yield k % 2 == 1, part

    def words(self, text: str) -> Iterator[list[str]]:
        """Words of a text in lists of bounded length; a special token is a list with its own string."""
        for special, part in self.pieces(text):
            if special:
                yield [part]
                continue
            part = self.normal(part)
            if self.is_unsure(part):
                yield [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
                continue
            rx = self.general if self.odd.search(part) else self.plain
            if len(part) <= CHUNK_CHARS:
                yield rx.findall(part)
            else:
                found = (x.group() for x in rx.finditer(part))
                while some := list(itertools.islice(found, CHUNK_CHARS // 4)):
                    yield some

    # -- speculation ---------------------------------------------------------------------------------------
    def _propose(self, symbols: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words in step: (word, token) of each proposal, in order within a word."""
        m, out_w, out_t = self.m, [], []
        w = np.arange(len(start))
        at, node, end, best = start.copy(), np.zeros_like(start), start.copy(), np.full(len(start), -1, np.int64)
        while len(w):
            inside = at < stop[w]
            key = node * 512 + symbols[np.minimum(at, len(symbols) - 1)]
            found, ok = _find(m.trie_keys, key)
            ok &= inside
            node = np.where(ok, m.trie_to[found], 0)
            at = np.where(ok, at + 1, at)
            token = m.trie_end[node]
            new = ok & (token >= 0)
            best, end = np.where(new, token, best), np.where(new, at, end)
            if not ok.all():
                cut = ~ok
                out_w.append(w[cut])
                out_t.append(best[cut])
                at, best = np.where(cut, end, at), np.where(cut, -1, best)
                go = ~(cut & (end >= stop[w]))
                w, at, node, end, best = w[go], at[go], node[go], end[go], best[go]
        out_w, out_t = np.concatenate(out_w), np.concatenate(out_t)
        order = np.argsort(out_w, kind="stable")
        return out_w[order], out_t[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a then b leaves these two tokens, by undoing their histories side by side."""
        m = self.m
        fine = np.ones(len(a), bool)
        k, x, y = np.arange(len(a)), a.copy(), b.copy()
        used_x, used_y = np.full(len(a), _NONE), np.full(len(a), _NONE)
        while len(k):
            at, known = _find(m.pair_keys, x * m.size + y)
            rank = np.where(known, m.pair_ranks[at], _NONE)
            bad = known & (rank < used_x) & (rank <= used_y)
            fine[k[bad]] = False
            bx, by = m.born[x], m.born[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            k, x, y, used_x, used_y, bx, by = (v[go] for v in (k, x, y, used_x, used_y, bx, by))
            first = bx > by
            used_x, used_y = np.where(first, bx, used_x), np.where(first, used_y, by)
            x, y = np.where(first, m.right[x], x), np.where(first, y, m.left[y])
        return fine

    def _judged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, back = np.unique(a * self.m.size + b, return_inverse=True)
        at, known = _find(self.pairs, keys)
        verdict = np.zeros(len(keys), bool)
        verdict[known] = self.fits[at[known]]
        fresh = keys[~known]
        if len(fresh):
            verdict[~known] = new = self.compatible(fresh // self.m.size, fresh % self.m.size)
            if len(self.pairs) > 2_000_000:
                self.pairs, self.fits = fresh, new
            else:
                put = np.searchsorted(self.pairs, fresh)
                self.pairs, self.fits = np.insert(self.pairs, put, fresh), np.insert(self.fits, put, new)
        return verdict[back]

    def _learn(self, words: list[str]) -> None:
        """Encode new distinct words and append them to the tables."""
        data = [x.encode("utf-8", "surrogatepass") for x in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        symbols = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        stop = np.cumsum(size)
        start = stop - size
        if self.m.kind == "words":
            symbols[stop - 1] += 256
        whole = np.zeros(len(words), bool)
        if self.m.specials and any(s in words for s in self.m.specials):
            whole |= np.fromiter((w in self.m.specials for w in words), bool, len(words))
        slow = whole | (size > LONG_WORD) | (not self.m.proper)
        quick = np.flatnonzero(~slow)
        w, t = self._propose(symbols, start[quick], stop[quick]) if len(quick) else (np.zeros(0, np.int64),) * 2
        if len(w) > 1:
            same = w[1:] == w[:-1]
            bad = ~self._judged(t[:-1][same], t[1:][same])
            failed = np.zeros(len(quick), bool)
            failed[w[1:][same][bad]] = True
            slow[quick[failed]] = True
            keep = ~failed[w]
            w, t = w[keep], t[keep]
        w = quick[w]
        redo = np.flatnonzero(slow)
        exact = [[self.m.specials[words[k]]] if whole[k] else self.m.merge(symbols[start[k] : stop[k]]) for k in redo]
        self.words_seen += len(words)
        self.words_merged += len(redo)
        if exact:
            w = np.concatenate([w, np.repeat(redo, [len(x) for x in exact])])
            t = np.concatenate([t, np.fromiter(itertools.chain.from_iterable(exact), np.int64)])
            order = np.argsort(w, kind="stable")
            w, t = w[order], t[order]
        counts = np.bincount(w, minlength=len(words))
        self.offsets = np.concatenate([self.offsets, len(self.tokens) + np.cumsum(counts) - counts])
        self.counts, self.tokens = np.concatenate([self.counts, counts]), np.concatenate([self.tokens, t])

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens of each word) of a list of words."""
        if len(self.numbers) > CACHE_WORDS:
            self._forget()
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.fresh:
            fresh, self.numbers.fresh = self.numbers.fresh, []
            self._learn(fresh)
        counts = self.counts[number]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.offsets[number] - (ends - counts), counts)
        return self.tokens[at].astype(np.uint32), counts

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text as unsigned 32-bit integers; null as empty."""
        parts = [self._ids(x)[0] for x in self.words(text or "") if x]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text in order; short texts share the vectorised steps."""
        held: list[list[str]] = []
        sizes: list[int] = []
        n = 0

        def flush() -> Iterator[np.ndarray]:
            ids, counts = self._ids(list(itertools.chain.from_iterable(held))) if n else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum(counts)])
            cuts = ends[np.cumsum(sizes)] if sizes else []
            yield from np.split(ids, cuts[:-1]) if sizes else []
            held.clear()
            sizes.clear()

        for text in texts:
            text = text or ""
            if len(text) > CHUNK_CHARS:
                yield from flush()
                n = 0
                yield self.encode(text)
                continue
            words = list(itertools.chain.from_iterable(self.words(text)))
            held.append(words)
            sizes.append(len(words))
            n += len(words)
            if n > CHUNK_CHARS // 8:
                yield from flush()
                n = 0
        yield from flush()

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.m.joined:
            return " ".join(map(self.m.shown.__getitem__, ids.tolist()))
        return b"".join(map(self.m.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")


_MODELS: dict[str, BpeModel] = {}
_ENCODERS: dict[str, Encoder] = {}


def model_of(path: str) -> BpeModel:
    """The tables of a file, built once a process."""
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
    return _MODELS[path]


def encoder_of(model: BpeModel) -> Encoder:
    """One encoder for each tokenizer in a Python worker."""
    key = sys.intern(model.source)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]
