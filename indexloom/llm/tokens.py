"""Token counts: a table with the exact count at every prefix of a text."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts are cut at these characters before anything else; to the vocabulary they are plain white space.
_AS_SPACE = "\n\t\r\x0b\x0c"
CACHE_ENTRIES = 700_000
LONG_PIECE = 48

# How the vocabulary parts text into words.
_CLITICS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_SPLIT = "|".join(_CLITICS) + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = regex.compile(_SPLIT)

_ENCODERS: dict[str, Encoder] = {}


def _words(piece: str) -> list[str]:
    low = piece.lower()
    if low.isalpha():
        return [low]
    if low[-1] in ".,!?" and low[:-1].isalpha():
        return [low[:-1], low[-1]]
    return _WORDS.findall(low)


# Latin letters and signs that no neighbour composes with and whose lower case is one character; no other white space.
_PLAIN = re.compile("[\x00-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]+").fullmatch


def _class_of(kinds: str) -> str:
    """The plain characters of these Unicode categories, or those of none of them that are no white space, as a set."""
    plain = [chr(c) for c in range(0x250) if _PLAIN(chr(c))]
    if kinds:
        chosen = [c for c in plain if unicodedata.category(c)[0] in kinds]
    else:
        chosen = [c for c in plain if unicodedata.category(c)[0] not in "LN" and c not in " " + _AS_SPACE]
    return "[" + "".join(map(re.escape, chosen)) + "]"


# The same words, for texts of plain characters only, in lower case.
_PLAIN_WORDS = re.compile("|".join([*_CLITICS, _class_of("L") + "+", _class_of("N"), _class_of("") + "+"])).findall


def _is_plain(piece: str) -> bool:
    """Whether lower case and parting into words can be told without the library: plain letters, no special string."""
    return _PLAIN(piece) is not None and "<|" not in piece


class Memory:
    """A bounded memory of two generations. What is asked for moves to the young one; when that is full it becomes the old
    one, and what nobody asked for since the last change is forgotten."""

    def __init__(self, entries: int):
        self.most = entries // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> set[str]:
        """Keys that are to be learned; all others are in the young generation from now on."""
        # a set less the keys of a dictionary would go through all of those
        new = set(filterfalse(self.young.__contains__, keys))
        if len(self.young) + len(new) > self.most:
            self.young, self.old = {}, self.young
            new = keys
        again = set(filter(self.old.__contains__, new))
        self.young.update((k, self.old[k]) for k in again)
        return new - again


def _id_bytes(encoding) -> bytes:
    return np.asarray(encoding.ids, dtype="<u4").tobytes()


def _has_known_rules(path: str) -> bool:
    """Whether a vocabulary lower-cases and parts texts the way this module does without the library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def kinds(part: dict | None, name: str) -> list[str]:
        return [p["type"] for p in part.get(name, [part])] if part else []

    split = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
    return (
        kinds(spec["normalizer"], "normalizers") == ["NFC", "Replace", "Lowercase"]
        and kinds(spec["pre_tokenizer"], "pretokenizers") == ["Split", "ByteLevel"]
        and split[0]["pattern"].get("Regex") == _SPLIT
        and spec["model"]["type"] == "BPE"
        and spec["model"].get("end_of_word_suffix") == WordMerges.END
    )


class Encoder:
    """One vocabulary in one worker process, with what it has learned of pieces between spaces.

    No token of a white-space-dropping vocabulary spans two pieces, so a text's tokens are those of its pieces in order.
    Memories have two generations: what was not met since the last change is forgotten, which costs time and changes nothing.
    A vocabulary with other rules than these has its ids from the library, and no prefix tables.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        self.path = path
        self.together: BatchMerges | None = None
        self.library = Tokenizer.from_file(path)
        self.known = _has_known_rules(path)
        self.words = Memory(CACHE_ENTRIES)
        self.ids = Memory(CACHE_ENTRIES)
        self.tables: dict[str, bytes] = {"": b"\0\0"}
        self.counts: dict[str, int] = {"": 0}
        self.merges: WordMerges | None = None
        self.wide = False  # whether a piece has more tokens than 16 bits hold

    @staticmethod
    def pieces(text: str) -> list[str]:
        if "<|" not in text and _PLAIN(text):
            text = text.lower()  # as the vocabulary does; fewer different pieces to learn
        for c in _AS_SPACE:
            text = text.replace(c, " ")
        return text.split(" ")

    def _encode(self, strings: list[str]):
        return self.library.encode_batch(strings, add_special_tokens=False)

    def _batch(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        self.together = self.together or BatchMerges(self.path)
        return self.together.encode(words)

    def _counts_of(self, words: set[str]) -> None:
        missing = [w for w in words if w not in self.counts]
        if missing:
            self.counts.update(zip(missing, self._batch(missing)[1], strict=True))

    def learn_words(self, words: set[str]) -> None:
        """Ids of plain words."""
        missing = list(self.words.missing(words))
        short = [w for w in missing if len(w) <= LONG_PIECE]
        self.words.young.update(zip(short, self._batch(short)[0], strict=True))
        long = [w for w in missing if len(w) > LONG_PIECE]
        self.words.young.update(zip(long, map(_id_bytes, self._encode(long)), strict=True))

    def learn_ids(self, pieces: set[str]) -> None:
        """Ids of pieces of texts that are not plain throughout."""
        plain, odd = {}, []
        for piece in self.ids.missing(pieces):
            if len(piece) <= LONG_PIECE and piece and _is_plain(piece):
                plain[piece] = _words(piece)
            else:
                odd.append(piece)
        self.learn_words({w for ws in plain.values() for w in ws})
        words, ids = self.words.young, self.ids.young
        ids.update((p, b"".join([words[w] for w in ws])) for p, ws in plain.items())
        ids.update(zip(odd, map(_id_bytes, self._encode(odd)), strict=True))

    def batch_ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as unsigned little-endian 32-bit numbers."""
        if not self.known:
            return map(_id_bytes, self._encode(texts))
        plain = ["<|" not in t and _PLAIN(t) is not None for t in texts]
        split = [_PLAIN_WORDS(t.lower()) if own else self.pieces(t) for t, own in zip(texts, plain, strict=True)]
        self.learn_ids(set().union(*[p for p, own in zip(split, plain, strict=True) if not own]))
        self.learn_words(set().union(*[p for p, own in zip(split, plain, strict=True) if own]))
        words, ids = self.words.young.__getitem__, self.ids.young.__getitem__
        return (b"".join(map(words if own else ids, p)) for p, own in zip(split, plain, strict=True))

    def learn_tables(self, pieces: set[str]) -> None:
        """Counts at every prefix of these pieces, the empty one and the piece itself included."""
        if not self.known:
            raise ValueError(f"{self.path} parts texts by rules that prefix tables are not made for")
        missing = set(filterfalse(self.tables.__contains__, pieces))
        if len(missing) + len(self.tables) > CACHE_ENTRIES:
            self.tables = {"": b"\0\0"}
            missing = pieces - {""}
        if len(self.counts) > 2 * CACHE_ENTRIES:
            self.counts = {"": 0}
        plain, odd = {}, []
        for piece in missing:
            if len(piece) > LONG_PIECE:
                self.tables[piece] = self._long_table(piece)
            elif _is_plain(piece):
                plain[piece] = _words(piece)
            else:
                odd.append(piece)
        # words share their first letters, so most prefixes are known already
        new = set(filterfalse(self.counts.__contains__, {w for ws in plain.values() for w in ws}))
        self._counts_of({w[:i] for w in new for i in range(1, len(w) + 1)} | {c for x in _CLITICS for c in x[1:]})
        for piece, ws in plain.items():
            self.tables[piece] = self._plain_table(ws)
        found = iter(self._encode([x[:i] for x in odd for i in range(1, len(x) + 1)]))
        for x in odd:
            self.tables[x] = array("H", [0, *[len(next(found).ids) for _ in x]]).tobytes()

    def _plain_table(self, words: list[str]) -> bytes:
        """Words end where they end whatever follows, so a prefix is whole words and the prefix of one."""
        out, base, counts = [0], 0, self.counts
        for word in words:
            if word[0] == "'" and word in _CLITICS:
                # cut short, these are a sign and letters
                out += [base + sum([counts[w] for w in _WORDS.findall(word[:i])]) for i in range(1, len(word))]
            else:
                out += [base + counts[word[:i]] for i in range(1, len(word))]
            base += counts[word]
            out.append(base)
        return array("H", out).tobytes()

    def _long_table(self, piece: str) -> bytes:
        """The same for a piece of any length, for which asking for every prefix would take its square."""
        out, base = [np.zeros(1, dtype="<i8")], 0
        for part in _safe_parts(piece):
            table = self._part_table(part)
            out.append(table + base)
            base += int(table[-1])
        table = np.concatenate(out)
        if int(table.max(initial=0)) > 0xFFFF:
            self.wide = True
            return b"wide" + table.astype("<u4").tobytes()
        return table.astype("<u2").tobytes()

    def _part_table(self, part: str) -> np.ndarray:
        if len(part) > 4 * LONG_PIECE and _keeps_length(part) and (part.isalpha() or _is_signs(part)):
            self.merges = self.merges or WordMerges(self.path)
            table = self.merges.prefix_counts(part)
            if int(table[-1]) == len(self._encode([part])[0].ids):
                return table
        found = []
        for i in range(1, len(part) + 1, 256):
            ends = [part[:j] for j in range(i, min(i + 256, len(part) + 1))]
            found += [len(e.ids) for e in self._encode(ends)]
        return np.array(found, dtype="<i8")

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact counts of text[:p] for p from 0 to its length."""
        pieces = self.pieces(text)
        tables = self.tables
        own = [tables[p] for p in pieces]
        if self.wide and any(t[:4] == b"wide" for t in own):
            parts = [np.frombuffer(t[4:], "<u4") if t[:4] == b"wide" else np.frombuffer(t, "<u2") for t in own]
            within = np.concatenate(parts).astype(np.int64)
        else:
            within = np.frombuffer(b"".join(own), dtype="<u2")
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + 1
        totals = within[np.cumsum(sizes) - 1].astype(np.int64)
        return (within + np.repeat(np.cumsum(totals) - totals, sizes)).astype(np.int32)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# Between two plain characters of different kinds the vocabulary always parts a piece; an apostrophe may bind what
# follows it, and the other signs left out belong to special strings.
_SAFE_CUT = re.compile(r"(?<=[a-zA-Z])(?=[0-9!-&(-/:;=?-@\[-`{}~])|(?<=[0-9])(?=[a-zA-Z0-9!-&(-/:;=?-@\[-`{}~])|(?<=[!-&(-/:;=?-@\[-`{}~])(?=[a-zA-Z0-9])")


def _safe_parts(piece: str) -> list[str]:
    return [x for x in _SAFE_CUT.split(piece) if x]


def _is_signs(part: str) -> bool:
    return all(not c.isalnum() and not c.isspace() and c not in "'<|>" and unicodedata.category(c)[0] in "PS" for c in part)


def _keeps_length(part: str) -> bool:
    return unicodedata.is_normalized("NFC", part) and all(len(c.lower()) == 1 for c in part)


class BatchMerges:
    """The merges of many short words at once: a row of symbols per word, one merge of each row per step."""

    SLOTS = 1 << 21
    NONE = np.int64(1) << 40

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = _byte_letters()
        self.size = len(vocab)
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + WordMerges.END] for c in letters], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        self.keys, self.ranks = np.full(self.SLOTS, -1, dtype=np.int64), np.full(self.SLOTS, self.NONE)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):  # each round places those whose slot is free and moves the others on
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            placed = np.zeros(len(slot), dtype=bool)
            placed[first] = True
            placed &= free
            self.keys[slot[placed]], self.ranks[slot[placed]] = keys[left[placed]], left[placed]
            left, slot = left[~placed], (slot[~placed] + 1) % self.SLOTS

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], self.NONE)
        for _ in range(self.probes - 1):
            slot = (slot + 1) % self.SLOTS
            out = np.where(self.keys[slot] == keys, self.ranks[slot], out)
        return out

    def encode(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids as unsigned little-endian 32-bit numbers, and their number, of each word."""
        if not words:
            return [], []
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ids: list[bytes] = [b""] * len(raw)
        counts = np.zeros(len(raw), dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for start, end in zip(bounds, [*bounds[1:], len(order)], strict=True):
            for i in range(start, end, 50_000):
                rows = order[i : min(end, i + 50_000)]
                symbols, kept = self._rows([raw[r] for r in rows], int(lengths[rows[0]]))
                counts[rows] = kept
                data = symbols.astype("<u4").tobytes()
                wide = 4 * symbols.shape[1]
                for k, (r, n) in enumerate(zip(rows.tolist(), kept.tolist(), strict=True)):
                    ids[r] = data[k * wide : k * wide + 4 * n]
        return ids, counts.tolist()

    def _rows(self, raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, length)
        symbols = self.inner[data]
        symbols[:, -1] = self.final[data[:, -1]]
        kept = np.full(len(raw), length, dtype=np.int64)
        if length == 1:
            return symbols, kept
        ranks = self._rank(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(raw))
        out = symbols.copy()
        columns = np.arange(length)
        while len(rows):
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            going = best < self.NONE
            out[rows[~going]] = symbols[~going]
            rows, symbols, ranks, at, best = rows[going], symbols[going], ranks[going], at[going], best[going]
            line = line[: len(rows)]
            kept[rows] -= 1
            # what stands after the pair moves one place to the left
            moved = np.concatenate([symbols[:, 1:], np.full((len(rows), 1), -1)], axis=1)
            symbols = np.where(columns <= at[:, None], symbols, moved)
            symbols[line, at] = self.made[best]
            moved = np.concatenate([ranks[:, 1:], np.full((len(rows), 1), self.NONE)], axis=1)
            ranks = np.where(columns[:-1] < at[:, None], ranks, moved)
            n = kept[rows]
            right = np.flatnonzero(at < n - 1)
            ranks[right, at[right]] = self._rank(symbols[right, at[right]], symbols[right, at[right] + 1])
            end = np.flatnonzero(at >= n - 1)
            ranks[end, np.minimum(at[end], length - 2)] = self.NONE
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._rank(symbols[left, at[left] - 1], symbols[left, at[left]])
        return out, kept


class WordMerges:
    """Prefix dynamic programming over the merges of one long word.

    A sequence of tokens is the encoding of its text if every two neighbours are the encoding of theirs. So the last
    token at each prefix is the longest one that stands beside the last token of what is before it, and counts follow.
    Only the end of a word has tokens of its own, so each prefix has two last tokens: one if the word goes on, one if
    it ends there.
    """

    END = "</w>"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.vocab = set(model["vocab"])
        self.longest = max(len(t.removesuffix(self.END)) for t in self.vocab)
        self.alike: dict[tuple[str, str], bool] = {}
        self.letters = _byte_letters()

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            ranked = [(self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        bare = token.removesuffix(self.END)
        return list(bare) if bare == token else [*bare[:-1], bare[-1] + self.END]

    def _fits(self, before: str, token: str) -> bool:
        key = (before, token)
        if key not in self.alike:
            whole = [before, token] if before else [token]
            self.alike[key] = self._merged([s for t in whole for s in self._symbols(t)]) == whole
        return self.alike[key]

    def prefix_counts(self, word: str) -> np.ndarray:
        encoded = [c.lower().encode() for c in word]
        text = "".join(self.letters[b] for c in encoded for b in c)
        last, counts = [""], [0]
        ended = [0]
        for i in range(1, len(text) + 1):
            for suffix, out in (("", counts), (self.END, ended)):
                for n in range(min(i, self.longest), 0, -1):
                    token = text[i - n : i] + suffix
                    if token in self.vocab and (n == i or last[i - n]) and self._fits(last[i - n], token):
                        out.append(counts[i - n] + 1)
                        if not suffix:
                            last.append(token)
                        break
                else:
                    out.append(1 << 40)
                    if not suffix:
                        last.append("")
        ends = np.cumsum([len(c) for c in encoded])
        return np.array(ended, dtype="<i8")[ends]


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def prefix_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, UTF-8 bytes, and `counts`, the exact token count of text[:p] for every p.

    `counts` has one entry per code point and one for the empty prefix. Counts are those of the library for the
    vocabulary file `tokenizer` (a path on every executor), without added tokens, truncation or padding; special strings
    inside a text are single tokens. A null text counts as empty. Rows are mapped one by one: no shuffle.
    """
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    typed = source.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(2)
            start = 0
            while start < batch.num_rows:
                chosen, chars = [], 0
                while start + len(chosen) < batch.num_rows and (not chosen or chars < 1_000_000):
                    text = texts[start + len(chosen)].as_py()
                    chosen.append(text)
                    chars += len(text)
                own.learn_tables({p for t in chosen for p in own.pieces(t)})
                arrays = [own.prefix_counts(t) for t in chosen]
                offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
                counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))
                part = batch.slice(start, len(chosen))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts], ["id", "n_bytes", "counts"])
                start += len(chosen)

    out = typed.mapInArrow(tables, f"id {kind.simpleString()}, n_bytes long, counts array<int>")
    return out.select(F.col("id").alias(id_col), "n_bytes", "counts")


def tokens_in(counts: Column, chars: Column | int | None = None) -> Column:
    """Tokens of the first `chars` code points, or of the whole text."""
    at = F.size(counts) - 1 if chars is None else F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts) - 1)
    return F.get(counts, at).cast("long")


def chars_within(counts: Column, budget: int) -> Column:
    """Length of the longest prefix with at most `budget` tokens."""
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i).otherwise(-1))
    return F.array_max(fits)
