"""Byte-level BPE encoding by speculation and verification, and decoding."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aerokpi.llm.hashing import window_hashes
from aerokpi.llm.units import UnitCache, chunks, spaced_units

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of more bytes are merged one by one, with a heap; shorter ones side by side.
LONG_WORD = 64
#: Bytes of text encoded at once, unless one text is larger.
CHUNK = 4 << 20
#: Encoded words kept per worker before the memory is emptied.
MEMORY = 300_000
NO_MERGE = np.iinfo(np.int64).max
_ENCODERS: dict[str, "SpeculativeBPE"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SpeculativeBPE:
    """Greedy longest match proposes a word's tokens. The proposal is right when every
    adjacent pair of tokens is compatible, that is, when merging the pair's bytes by rank
    gives this very pair back; only words with an incompatible pair are merged exactly.

    All pairs are tested at once by taking their last merges back: see `stands`. That holds
    where every token has one merge, of two tokens that came before it (as training gives);
    any other vocabulary is merged exactly throughout."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.size, self.tokens = size, [b""] * size
        for text, i in vocab.items():
            self.tokens[i] = bytes(alphabet[c] for c in text)
        self.of_byte = {t[0]: i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.byte_ids = np.array([self.of_byte.get(b, -1) for b in range(256)], dtype=np.int64)
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        sides = np.array([p for p in self.rank], dtype=np.int64).reshape(-1, 2)
        made = np.array([t for _, t in self.rank.values()], dtype=np.int64)
        ranks = np.array([r for r, _ in self.rank.values()], dtype=np.int64)
        keys = sides[:, 0] * size + sides[:, 1]
        order = np.argsort(keys)
        self.keys, self.key_ranks, self.key_tokens = keys[order], ranks[order], made[order]
        #: Rank of the merge that makes a token (-1: none), and its two sides.
        self.made_at, self.left, self.right = np.full(size, -1, dtype=np.int64), np.arange(size), np.arange(size)
        self.made_at[made], self.left[made], self.right[made] = ranks, sides[:, 0], sides[:, 1]
        self.regular = len(np.unique(made)) == len(made) and bool((self.made_at[sides].max(axis=1, initial=-1) < ranks).all())
        own = self.stands(sides[:, 0], sides[:, 1], ranks).tolist()
        whole = set(self.of_byte.values())
        whole.update(t for (a, b), (_, t), ok in zip(self.rank, self.rank.values(), own) if ok and a in whole and b in whole)
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        by_length: dict[int, list[int]] = {}
        for i in vocab.values():
            if i in whole:  # the merges of its own bytes end in it
                by_length.setdefault(len(self.tokens[i]), []).append(i)
        self.by_length = []
        for n, ids in sorted(by_length.items()):
            flat = np.frombuffer(b"".join(self.tokens[i] for i in ids), dtype=np.uint8)
            h = window_hashes(flat, n)[::n]
            order = np.argsort(h)
            self.by_length.append((n, h[order], np.array(ids, dtype=np.int64)[order]))
        self.words = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: the adjacent pair of lowest rank, leftmost first, merges until none does."""
        ids = [self.of_byte[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.rank[pair][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in self.rank:
                    heapq.heappush(queue, (self.rank[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in self.rank:
                heapq.heappush(queue, (self.rank[p][0], h, p))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """The exact encodings of many words: each round merges every word's leftmost pair of
        lowest rank; a word without a mergeable pair is done."""
        out: list[list[int]] = [self.merge(w) if len(w) > LONG_WORD else [] for w in words]
        live = np.array([i for i, w in enumerate(words) if 0 < len(w) <= LONG_WORD], dtype=np.int64)
        sizes = np.array([len(words[i]) for i in live], dtype=np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(words[i] for i in live), dtype=np.uint8)]
        ranks = np.full(len(ids), NO_MERGE)  # of each token with the next one of its word
        ranks[:-1] = self.merge_ranks(ids[:-1], ids[1:])
        ranks[np.cumsum(sizes) - 1] = NO_MERGE
        while len(live):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, starts)
            done = least == NO_MERGE
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[live[k]] = ids[starts[k] : starts[k] + sizes[k]].tolist()
                stay = np.repeat(~done, sizes)
                ids, ranks, live, sizes, least = ids[stay], ranks[stay], live[~done], sizes[~done], least[~done]
                if not len(live):
                    break
            word = np.repeat(np.arange(len(live)), sizes)
            at = np.flatnonzero(ranks == least[word])
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
            ids[at] = self.key_tokens[np.searchsorted(self.keys, ids[at] * self.size + ids[at + 1])]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, word, ranks, sizes = ids[keep], word[keep], ranks[keep], sizes - 1
            at -= np.arange(len(at))  # one token before each was taken away per earlier word
            for i in (at, at[at > 0] - 1):
                follows = i + 1 < len(ids)
                nxt = np.where(follows, i + 1, i)
                ranks[i] = np.where(follows & (word[nxt] == word[i]), self.merge_ranks(ids[i], ids[nxt]), NO_MERGE)
        return out

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words at once: (word number, token), by word."""
        end_at = np.repeat(ends, ends - starts)  # words lie end to end
        longest, token = np.zeros(len(data), dtype=np.int64), np.full(len(data), -1, dtype=np.int64)
        at = np.arange(len(data))
        for n, hashes, ids in self.by_length:
            h = window_hashes(data, n)
            here = np.flatnonzero(at[: len(h)] + n <= end_at[: len(h)])
            if not len(here):
                break
            found = np.minimum(np.searchsorted(hashes, h[here]), len(hashes) - 1)
            hit = hashes[found] == h[here]
            longest[here[hit]], token[here[hit]] = n, ids[found[hit]]
        words, tokens = [], []
        live, pos = np.arange(len(starts)), starts.copy()
        while len(live):
            words.append(live)
            tokens.append(token[pos])
            pos = pos + longest[pos]
            go = pos < ends[live]
            live, pos = live[go], pos[go]
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        word = np.concatenate(words)
        order = np.argsort(word, kind="stable")
        return word[order], np.concatenate(tokens)[order]

    def merge_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, beyond all ranks if there is none."""
        if not len(self.keys):
            return np.full(len(left), NO_MERGE)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NO_MERGE)

    def stands(self, left: np.ndarray, right: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether no merge of rank under `before` joins the two tokens of each pair, all pairs at once.

        The later-made token of a pair is taken apart, again and again: its side at the border
        was the other's neighbour until then, so those two must have no merge that came first.
        Merges go from the left, so on equal ranks the right token was made last, and a border
        merge of the same rank as the right token's would have come before it."""
        out = np.ones(len(left), dtype=bool)
        live = np.arange(len(left))
        while len(live):
            broken = self.merge_ranks(left, right) < before
            out[live[broken]] = False
            last_left, last_right = self.made_at[left], self.made_at[right]
            go = np.flatnonzero(~broken & (np.maximum(last_left, last_right) >= 0))
            live, left, right, last_left, last_right = live[go], left[go], right[go], last_left[go], last_right[go]
            in_left = last_left > last_right
            before = np.where(in_left, last_left, last_right + 1)
            left, right = np.where(in_left, self.right[left], left), np.where(in_left, right, self.left[right])
        return out

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of the words into `known`."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        starts = np.concatenate(([0], ends[:-1]))
        word, token = self.propose(data, starts, ends)
        failed = np.full(len(words), not self.regular)
        inside = np.flatnonzero(word[1:] == word[:-1])
        stands = self.stands(token[inside], token[inside + 1], np.full(len(inside), NO_MERGE))
        failed[word[inside[~stands]]] = True
        bounds = np.searchsorted(word, np.arange(len(words) + 1))
        tokens = token.tolist()
        exact = iter(self.merge_all([raw[i] for i in np.flatnonzero(failed).tolist()]))
        for w, bad, a, b in zip(words, failed.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            self.known[w] = next(exact) if bad else tokens[a:b]

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, end to end, and the number of each unit's ids. Its many short lists
        hold no cycles, so the collector of cycles pauses."""
        gc.disable()
        try:
            return self._encode(units)
        finally:
            gc.enable()

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split: list[list[str]] = []
        for unit in units:
            text = unit.decode()
            if self.splits and "<" in text:
                parts: list[str] = []
                for j, part in enumerate(self.splits.split(text)):
                    parts += [part] if j % 2 else self.words.findall(part)
                split.append(parts)
            else:
                split.append(self.words.findall(text))
        if len(self.known) > MEMORY:
            self.known.clear()
        self.known.update({s: [i] for s, i in self.special.items()})
        new = list({w: None for parts in split for w in parts if w not in self.known})
        if new:
            self.encode_words(new)
        known = self.known
        ids = [[i for w in parts for i in known[w]] for parts in split]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(lengths.sum())), lengths

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens as they are written; broken UTF-8 becomes U+FFFD."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encoder(path: str) -> tuple[SpeculativeBPE, UnitCache]:
    """One encoder and unit cache per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        bpe = SpeculativeBPE(path)
        _ENCODERS[path] = (bpe, UnitCache(bpe.encode))
    return _ENCODERS[path]


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
            with_text: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded ids in UTF-8), and on request `ids`
    (array<int>) and `decoded`.

    `vocabulary` is a byte-level BPE file of the tokenizers library; its special tokens are
    found in the text and no others are added. Words are encoded by `SpeculativeBPE`; each
    task works through its rows in chunks of bounded size, and nothing is shuffled.

    A null text counts as empty (no ids). Null ids and repeated rows stay as they are; an
    empty table gives an empty result; other columns are ignored.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("decoded", T.StringType())] * with_text
    schema = T.StructType(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        bpe, cache = encoder(vocabulary)
        arrow = to_arrow_schema(schema)
        for rows in batches:
            for a, b, data, offsets in chunks(rows.column(1), CHUNK):
                units, unit_rows = spaced_units(data, offsets)
                ids, at = cache.ids(units, unit_rows, b - a)
                each = [ids[at[i] : at[i + 1]] for i in range(b - a)]
                texts = [bpe.decode(x) for x in each]
                columns = [rows.column(0).slice(a, b - a), pa.array(np.diff(at)),
                           pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], type=pa.string()),
                           pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], type=pa.string())]
                columns += [pa.array([x.tolist() for x in each], type=pa.list_(pa.int32()))] * with_ids
                columns += [pa.array(texts, type=pa.string())] * with_text
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(work, schema)
