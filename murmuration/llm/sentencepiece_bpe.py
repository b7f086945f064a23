"""Exact SentencePiece BPE encoding and decoding by backtracking.

A vocabulary of merge pieces is compiled once on the driver (its size is that of the vocabulary, whatever the corpus)
and shipped to the tasks:

* an Aho-Corasick automaton finds, in one pass over a chunk, the longest piece that starts at each position;
* two neighbouring pieces are compatible if merging their joined characters again gives just those two pieces;
* the encoder takes the longest piece, steps to the longest shorter prefix where the neighbour refuses it, steps back
  where none is left, and marks positions from which no encoding exists in a bitfield, so none is tried twice.

A sequence whose neighbours are all compatible is the merge result, because scores are distinct. Runs of the blank
mark are the one family of pieces with equal scores; all of them rank below every other piece, so they are merged
last, the leftmost first, and their result repeats with the longest of them (checked when a model is loaded).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, lean, text_runs

MARK = "▁"
MEMO_ENTRIES = 160_000  # words, in each of two generations
PAIR_ENTRIES = 200_000
SHIFT = 20
MASK = (1 << SHIFT) - 1


class MergeTable:
    """What the encoder needs to know of a model: plain dictionaries, so that it pickles."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        if n > MASK:
            raise ValueError("more pieces than the encoder's numbers hold")
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {sp.piece_to_id(f"<0x{v:02X}>"): v for v in range(256)}
        self.byte_ids = [sp.piece_to_id(f"<0x{v:02X}>") for v in range(256)]
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.plain = {i: p.replace(MARK, " ") for i, (p, s) in enumerate(zip(self.text, special)) if not s}
        self.rank = {p: sp.get_score(i) for i, (p, s) in enumerate(zip(self.text, special)) if not s}
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.text, special)) if not s}
        runs = {p for p in self.rank if len(p) > 1 and not p.strip(MARK)}
        rest = [s for p, s in self.rank.items() if p not in runs and len(p) > 1]
        if len(set(rest)) != len(rest) or len({self.rank[p] for p in runs}) > 1:
            raise ValueError("pieces of equal score: this model's merges have no unique order")
        if runs and max(self.rank[p] for p in runs) >= min(rest):
            raise ValueError("runs of blanks do not rank last")
        if any(MARK in p[1:] for p in self.rank if p not in runs) or any("\n" in p for p in self.rank):
            raise ValueError("a piece spans a blank or a line end: chunks are not independent")
        if len(self.bytes) != 256 or self.unknown in self.bytes:
            raise ValueError("the model has no byte fallback")
        probe = sp.encode(" a  b ")
        if sp.decode(probe) != " a  b " or sp.encode("a")[0] != sp.encode(MARK + "a")[-1] and len(sp.encode("a")) != 1:
            raise ValueError("the model normalizes blanks: only plain blank marking with a leading mark is supported")
        m = self.longest_run = max(map(len, [MARK, *runs]))
        self.runs = [[self.ids[p] for p in self.merge(MARK * k)] for k in range(2 * m)]
        for k in range(2 * m, 4 * m):
            if [self.ids[p] for p in self.merge(MARK * k)] != self.run(k):
                raise ValueError("runs of blanks do not repeat")
        for p in runs:
            del self.rank[p]
        # Pieces that merging can't reach never occur in a result.
        self.rank = {p: s for p, s in self.rank.items() if len(p) == 1 or self.merge(p) == [p]}
        self.digest = hashlib.sha256(repr((self.text, sorted(self.rank.items()))).encode()).hexdigest()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.rank), "") for p in self.rank}

    def run(self, n: int) -> list[int]:
        """Ids of n blanks: beyond twice the longest run piece, each such piece more is one id more."""
        m = self.longest_run
        full = max(0, n // m - 1)
        return [self.ids[MARK * m]] * full + self.runs[n - full * m]

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short text: always the best-scored neighbours, the leftmost first."""
        parts, score, none = list(text), self.rank.get, float("-inf")
        ranks = [score(x + y, none) for x, y in zip(parts, parts[1:])]
        while ranks:
            best = max(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = score(parts[i] + parts[i + 1], none)
        return parts


class _Memo(dict):
    """A bounded memo of two generations: a full one becomes the older, what is asked for again comes back from there.

    Its bound costs time only and changes no result.
    """

    def __init__(self, make, entries: int = MEMO_ENTRIES):
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder; one serves all tasks of a worker process (see codec_of), so that its memos stay warm.

    Pieces are numbers here: a match is (length - 1) << SHIFT | id, so of two matches the greater is the longer.
    """

    def __init__(self, table: MergeTable):
        import ahocorasick

        self.table = table
        match = {p: len(p) - 1 << SHIFT | table.ids[p] for p in table.rank}
        self.auto = ahocorasick.Automaton()
        for p, m in match.items():
            if len(p) > 1:
                self.auto.add_word(p, m)
        self.auto.make_automaton()
        self.single = {p: m for p, m in match.items() if len(p) == 1}
        self.shorter = {m: match.get(table.shorter[p], -1) for p, m in match.items()}
        self.fits = _Memo(self._fits, PAIR_ENTRIES)
        self.marked = _Memo(lambda word: self._entry(MARK + word, " " + word))
        self.bare = _Memo(lambda word: self._entry(word, word))
        self.spelled = [str(i) for i in range(len(table.text))]
        self.lone = self.spelled[table.ids[MARK]]

    def _fits(self, pair: int) -> bool:
        """Whether two neighbouring pieces stay as they are when their text is merged again."""
        left, right = self.table.text[pair >> SHIFT], self.table.text[pair & MASK]
        return self.table.merge(left + right) == [left, right]

    def _entry(self, chunk: str, plain: str) -> str | tuple[str, str]:
        """Ids of a chunk, joined by commas; with the text that they decode to where that is another than the chunk's."""
        ids = self.chunk_ids(chunk)
        joined, said = ",".join([self.spelled[i] for i in ids]), self.pieces_text(ids)
        return joined if said == plain else (joined, said)

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk with a blank mark at its start at most."""
        single, n = self.single, len(chunk)
        try:
            longest = [single[c] for c in chunk]
        except KeyError:  # a character that is no piece merges with nothing, so what is around it stands alone
            k = next(i for i, c in enumerate(chunk) if c not in single)
            spelled = [self.table.byte_ids[v] for v in chunk[k].encode()]
            return [*self.chunk_ids(chunk[:k]), *spelled, *self.chunk_ids(chunk[k + 1 :])]
        for end, m in self.auto.iter(chunk):
            at = end - (m >> SHIFT)
            if m > longest[at]:
                longest[at] = m
        fits, shorter, failed, out, at = self.fits, self.shorter, 0, [], 0
        m = longest[0] if n else 0
        while at < n:
            end = at + (m >> SHIFT) + 1
            if not (failed and failed >> end & 1) and (not out or fits[(out[-1] & MASK) << SHIFT | m & MASK]):
                out.append(m)
                at = end
                if at < n:
                    m = longest[at]
                continue
            m = shorter[m]
            while m < 0:  # nothing fits from here: this position fails for good, the piece before must shrink
                failed |= 1 << at
                last = out.pop()
                at -= (last >> SHIFT) + 1
                m = shorter[last]
        return [m & MASK for m in out]

    def _parts(self, parts: list[str], out: list[str], text: list[str]) -> None:
        """Parts of a line after its first word, where blanks repeat or end it, or a word decodes to another text."""
        blanks = 0
        for word in parts:
            if not word:
                blanks += 1
                continue
            ids = self.marked[word]
            ids, said = (ids, " " + word) if isinstance(ids, str) else ids
            if blanks:
                head, _, tail = ids.partition(",")
                joins = head == self.lone
                run = self.table.run(blanks + joins)
                out.append(",".join(map(str, run)))
                text.append(self.pieces_text(run))
                ids, said, blanks = (tail, said[1:], 0) if joins else (ids, said, 0)
            if ids:
                out.append(ids)
                text.append(said)
        if blanks:
            run = self.table.run(blanks)
            out.append(",".join(map(str, run)))
            text.append(self.pieces_text(run))

    def encode(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by commas, and the text that decoding them gives."""
        if not text:
            return "", ""
        out: list[str] = []
        said: list[str] = []
        end = self.spelled[self.table.byte_ids[10]]
        marked = self.marked.__getitem__
        for i, line in enumerate((" " + text.replace(MARK, " ")).split("\n")):
            if i:
                out.append(end)
                said.append("\n")
            first, *rest = line.split(" ")
            if first:
                ids = self.bare[first]
                ids, word = (ids, first) if isinstance(ids, str) else ids
                out.append(ids)
                said.append(word)
            if not rest:
                continue
            if "" not in rest:
                try:
                    out.append(",".join(map(marked, rest)))
                    said.append(line[len(first) :])  # each word's ids were decoded and compared when its entry was made
                    continue
                except TypeError:
                    pass
            self._parts(rest, out, said)
        return ",".join(out), "".join(said)[1:]

    def pieces_text(self, ids: list[int]) -> str:
        """Text of ids with a blank for each mark; bytes that are not UTF-8 become U+FFFD one by one."""
        try:
            return "".join([self.table.plain[i] for i in ids])
        except KeyError:
            pass
        t, out, held = self.table, [], bytearray()
        for i in [*ids, None]:
            if i in t.bytes:
                held.append(t.bytes[i])
                continue
            while held:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(held[:k].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k = 1
                del held[:k]
            if i is not None and i not in t.silent:
                out.append(" ⁇ " if i == t.unknown else t.text[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec_of(table: MergeTable) -> Codec:
    """The codec of this worker process for a table; tasks that follow each other find its memos warm."""
    if table.digest not in _codecs:
        _codecs.clear()
        _codecs[table.digest] = Codec(table)
    return _codecs[table.digest]


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves (array of int) and the decoded
    text. One pass, no shuffle; rows are held in runs of bounded text, so a very long text costs its own length only. A null
    or empty text has no ids. Rows repeat as they come; other columns of df play no part. An empty table gives an empty
    result.
    """
    table = MergeTable(model_path)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += (", ids array<int>" if ids else "") + (", decoded string" if decoded else "")
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(table)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for keys, texts in (piece for batch in batches for piece in text_runs(batch)):
            n, digest, back, every, said_all = [], [], [], [], []
            for text in texts:
                joined, said = codec.encode(text or "")
                n.append(joined.count(",") + 1 if joined else 0)
                digest.append(sha(joined))
                back.append(sha(said))
                if ids and joined:
                    every.append(joined)
                if decoded:
                    said_all.append(said)
            cols = [keys, pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            if ids:
                flat = np.fromstring(",".join(every), np.int32, sep=",") if every else np.array([], np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat)))
            if decoded:
                cols.append(pa.array(said_all, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return bounded_batches(df.select(id_col, text_col)).mapInArrow(lean(run), schema)
