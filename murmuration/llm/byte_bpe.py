"""Exact byte-level BPE encoding and decoding by speculation and verification.

Words are encoded many at a time. Greedy longest match proposes tokens for all words of a batch in one scan; one
vectorised check tests every pair of neighbouring tokens; a word all of whose pairs fit is done, as no merge across a
boundary would have come before those that made the tokens. Only words with a pair that does not fit are merged exactly.

Two tokens fit if no piece on the right edge of the left one's merges and piece on the left edge of the right one's,
both there at the same time, form a merge that comes before each of them is merged further. A merge ranks later than
those that made its parts (checked when a model is loaded), so edges are walked from the last merge back, all pairs at
once.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, lean, text_runs

WORDS_AT_ONCE = 200_000
TOKENS_AT_ONCE = 500_000
MEMO_WORDS = 300_000  # in each of two generations; a bound of memory, it changes no result
SHORT = 40  # bytes; longer words are merged by a heap
LAST = 1 << 40
NEVER = np.int64(LAST)
GAP = "Ā"  # parts words in a scan; bytes are the characters below it

#: White space of the splitting rule; a letter, a number, white space and another character, which stand for their classes.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CLASSES = "a1\t%"


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    more = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(more)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def _classes(path: str) -> list[str]:
    """Class of every character by the tokenizer's own Unicode tables, a letter a character: from this Python's, corrected where they differ."""
    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    patterns = [(regex.compile(r"\p{L}"), "a"), (regex.compile(r"\p{N}"), "1"), (regex.compile(f"[{SPACES}]"), "\t")]
    out = []
    for start in range(0, 0x110000, 4096):
        chars = [chr(c) for c in range(start, start + 4096)]
        mine = [next((k for p, k in patterns if p.match(c)), "%") for c in chars]
        ask = [i for i, c in enumerate(chars) if c != " " and not "\ud800" <= c <= "\udfff"]  # a blank joins the next word
        cuts = lambda s: [at for _, at in split("".join(s))]
        if cuts(f"x{mine[i]}7{mine[i]}%{mine[i]}x" for i in ask) != cuts(f"x{chars[i]}7{chars[i]}%{chars[i]}x" for i in ask):
            for i in ask:
                got = cuts(f"x{chars[i]}7{chars[i]}%{chars[i]}x")
                mine[i] = next(k for k in (mine[i], *CLASSES) if cuts(f"x{k}7{k}%{k}x") == got)
        out += mine
    return out


def _ranges(classes: list[str], kind: str) -> str:
    """Body of a character class with the characters of a kind up to U+FFFF."""
    out, at = [], 0
    for k, run in itertools.groupby(classes[:0x10000]):
        n = len(list(run))
        if k == kind:
            out.append(f"\\u{at:04x}-\\u{at + n - 1:04x}")
        at += n
    return "".join(out)


class MergeRules:
    """What the encoder needs to know of a tokenizer file: arrays and dictionaries, so that it pickles."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, pre, post = said["model"], said["pre_tokenizer"], said["decoder"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or said["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or post["type"] != "ByteLevel":
            raise ValueError("only byte-level BPE without normalizer, prefix blank and dropout is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in said["added_tokens"]):
            raise ValueError("added tokens that take in blanks or ask for word ends are not supported")
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_letters())}
        raw = {bytes(back[c] for c in token): i for token, i in model["vocab"].items()}
        self.base = [raw[bytes([b])] for b in range(256)]
        n = 1 + max([*raw.values(), *self.added.values()])
        self.rank, self.left, self.right = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, (a, b) in enumerate(pairs):
            a, b, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if self.rank[z] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError("a token has two merges, or a merge comes before its parts")
            self.rank[z], self.left[z], self.right[z] = r, a, b
            self.merges[a, b] = r
            self.made.append(z)
        if any(self.rank[i] < 0 for i in set(raw.values()) - set(self.base)):
            raise ValueError("a token has no merge")
        self.spelling = {i: t for t, i in raw.items()} | {i: t.encode() for t, i in self.added.items()}
        # Tokens that merging can't reach never occur in a result.
        self.reached = {t: i for t, i in raw.items() if len(t) == 1 or self.merge(t) == [i]}
        classes = _classes(path)
        letter, number = _ranges(classes, "a"), _ranges(classes, "1")
        other = f"[^{SPACES}{letter}{number}]"
        # Contractions come before the runs of other characters, the only ones that may start with an apostrophe.
        self.split = rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?{other}+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
        self.stands = {c: classes[c] for c in range(0x10000, 0x110000) if classes[c] != "%"}
        self.digest = hashlib.sha256(repr((sorted(raw.items()), pairs, sorted(self.added.items()))).encode()).hexdigest()

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the first of the merges that apply, the leftmost place first, until none applies."""
        ids, rule = [self.base[b] for b in word], self.merges.get
        if len(ids) > SHORT:
            return self._merge_long(ids)
        ranks = [rule(p, LAST) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < LAST:
            i = ranks.index(best)
            ids[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rule((ids[i - 1], ids[i]), LAST)
            if i < len(ranks):
                ranks[i] = rule((ids[i], ids[i + 1]), LAST)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of places over a linked list, so that a word of n bytes takes n log n steps."""
        n, rule = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rule((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of its sides has been merged since
            z = self.made[r]
            ids[i], ids[j] = z, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := rule((z, ids[j]))) is not None:
                    heapq.heappush(heap, (r, i, z, ids[j]))
            k = before[i]
            if k >= 0 and (r := rule((ids[k], z))) is not None:
                heapq.heappush(heap, (r, k, ids[k], z))
        return [i for i in ids if i >= 0]


class ByteCodec:
    """Encoder and decoder; one serves all tasks of a worker process, so that its memo stays warm."""

    def __init__(self, rules: MergeRules):
        import ahocorasick

        self.rules = rules
        self.auto = ahocorasick.Automaton()
        for token, i in rules.reached.items():
            self.auto.add_word(token.decode("latin-1"), i)
        self.auto.make_automaton()
        self.split = re.compile(rules.split)
        self.high = re.compile("[\U00010000-\U0010ffff]")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(rules.added, key=len, reverse=True))) + ")") if rules.added else None
        keys = sorted((a << 32 | b, r) for (a, b), r in rules.merges.items())
        self.pairs, self.pair_ranks = np.array([k for k, _ in keys]), np.array([r for _, r in keys])
        spelled = [rules.spelling.get(i, b"") for i in range(len(rules.rank))]
        self.lengths = np.array([len(s) for s in spelled])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a[i] and b[i] stay as they are when they stand next to each other."""
        rank, good = self.rules.rank, np.ones(len(a), bool)
        rows, ends_a, ends_b = np.arange(len(a)), np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(rows):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            meets = np.where(self.pairs[at] == key, self.pair_ranks[at], NEVER)
            # Of places of equal rank the left one goes first: a's own next merge lies left of the boundary, b's right of it.
            bad = (meets < ends_a) & (meets <= ends_b) & (meets < NEVER)
            good[rows[bad]] = False
            ra, rb = rank[a], rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            rows, a, b, ra, rb, ends_a, ends_b = (x[on] for x in (rows, a, b, ra, rb, ends_a, ends_b))
            later = ra > rb  # the side that was made last is taken apart
            ends_a, ends_b = np.where(later, ra, ends_a), np.where(later, ends_b, rb)
            a, b = np.where(later, self.rules.right[a], a), np.where(later, b, self.rules.left[b])
        return good

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: proposals for all, one check of all pairs, exact merging where a pair fails."""
        if not words:
            return []
        found = list(self.auto.iter_long(GAP.join([w.decode("latin-1") for w in words])))
        last, ids = np.array([e for e, _ in found], np.int64), np.array([i for _, i in found], np.int64)
        sizes = np.array([len(w) for w in words])
        word = np.searchsorted(np.cumsum(sizes + 1), last, side="right")
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair, back = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
        failed = np.zeros(len(words), bool)
        failed[word[inner[~self.fits(pair >> 32, pair & 0xFFFFFFFF)[back]]]] = True
        small = ids.astype("<u4")
        out = [small[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k in np.flatnonzero(failed).tolist():
            out[k] = np.array(self.rules.merge(words[k]), "<u4")
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the words that the memo lacks; a full memo becomes the older one, what is asked for again comes back from there."""
        if len(self.known) > MEMO_WORDS:
            self.known, self.older = {}, self.known
        new = []
        for w in words.difference(self.known):
            ids = self.older.get(w)
            if ids is None:
                new.append(w)
            else:
                self.known[w] = ids
        for w, ids in zip(new, self.encode_words([w.encode() for w in new])):
            self.known[w] = ids.tobytes()

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Words of a text without added tokens, in bounded lists."""
        if len(text) <= 4 * WORDS_AT_ONCE and (text.isascii() or not self.high.search(text)):
            yield self.split.findall(text)
            return
        like = text.translate(self.rules.stands)  # characters beyond U+FFFF by one of their class; places stay
        spans = (m.span() for m in self.split.finditer(like))
        while some := [text[a:b] for a, b in itertools.islice(spans, WORDS_AT_ONCE)]:
            yield some

    def encode_run(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = []
        waiting: list[tuple[list[bytes], int, list[str]]] = []  # (parts of a text, place to fill, words)
        held = 0

        def settle() -> None:
            self.learn({w for _, _, words in waiting for w in words})
            for parts, k, words in waiting:
                parts[k] = b"".join(map(self.known.__getitem__, words))
            waiting.clear()

        for text in texts:
            parts: list[bytes] = []
            out.append(parts)
            for i, plain in enumerate(self.special.split(text) if self.special else [text]):
                if i % 2:
                    parts.append(self.rules.added[plain].to_bytes(4, "little"))
                    continue
                for words in self._pieces(plain):
                    parts.append(b"")
                    waiting.append((parts, len(parts) - 1, words))
                    held += len(words)
                    if held >= WORDS_AT_ONCE:
                        settle()
                        held = 0
        settle()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        every, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(every), TOKENS_AT_ONCE):
            some = every[k : k + TOKENS_AT_ONCE]
            n = self.lengths[some]
            ends = np.cumsum(n)
            out.append(self.letters[np.arange(ends[-1]) + np.repeat(self.starts[some] - ends + n, n)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_codecs: dict[str, ByteCodec] = {}


def codec_of(rules: MergeRules) -> ByteCodec:
    """The codec of this worker process for a tokenizer; tasks that follow each other find its memo warm."""
    if rules.digest not in _codecs:
        _codecs.clear()
        _codecs[rules.digest] = ByteCodec(rules)
    return _codecs[rules.digest]


def encode_byte_bpe(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Encode every text with a byte-level BPE tokenizer file and decode the ids again.

    Returns id_col, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 and, if asked
    for, the ids themselves (array of int) and the decoded text. The string of an added token in a text is that token. One
    pass, no shuffle: the rules are shipped to the tasks (their size is the vocabulary's, whatever the corpus), rows are held
    in runs of bounded text, so a very long text costs its own length only. A null or empty text has no ids. Rows repeat as
    they come, also with a null id; other columns of df play no part. An empty table gives an empty result.
    """
    rules = MergeRules(path)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += (", ids array<int>" if ids else "") + (", decoded string" if decoded else "")
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(rules)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for keys, texts in (piece for batch in batches for piece in text_runs(batch)):
            coded = codec.encode_run([t or "" for t in texts])
            said, n = [codec.decode(b) for b in coded], [len(b) // 4 for b in coded]
            cols = [keys, pa.array(n, pa.int64()), pa.array(map(sha, coded), pa.string()), pa.array([sha(s.encode()) for s in said], pa.string())]
            if ids:
                flat = np.frombuffer(b"".join(coded), "<i4")
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat)))
            if decoded:
                cols.append(pa.array(said, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return bounded_batches(df.select(id_col, text_col)).mapInArrow(lean(run), schema)
