"""SentencePiece encoding and decoding by a table of every prefix's last token.

A BPE encoding is right exactly if each token is what its own text merges to and each two neighbours, encoded together,
stay these two: until a merge crosses a boundary, what happens on one side of it does not depend on the other side, so
the first merge to cross any boundary would also cross it for the two neighbours alone. So each prefix of a text has one
last token: the piece that ends there, is its own encoding, and is compatible with the last token of the prefix before
it. An automaton over all pieces finds those that end at each place, a remembered test of pairs picks the one, and the
ids are recovered from the end backwards. The time grows with the length of the text, whatever it holds.

No piece has a space mark after another character, or a letter beside a character that is none (both checked when a model is
read), and some characters are in no piece; no merge crosses such places, so a text is cut there, and what is between is encoded
once and remembered, up to a bound. A pair is tested by taking its merges back from the last one; nothing is merged for it.

Null and empty texts have no ids and decode to the empty string. Bytes that are no UTF-8 count as U+FFFD. A null list of
ids decodes to the empty string, a null id or one beyond the table is an error. Texts of any length are taken whole. Rows
that repeat are rows; an empty table gives none; a column named like the one that is added is replaced.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.store import table

MARK = "▁"
#: What a task remembers at most: encoded runs, tested pairs of tokens. Both are emptied when full.
RUNS, PAIRS = 1 << 18, 1 << 20
#: Runs longer than this are not remembered.
RUN_CHARS = 48
#: Tokens in a batch that a task returns, unless one text has more.
BATCH_TOKENS = 1 << 21
# Field numbers and codes of the model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message: numbers as such, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte, at = data[at], at + 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield field, data[at : at + size]
        at += size


class Pieces:
    """A model's pieces. Made of the bytes of a model file, once a process."""

    def __init__(self, model: bytes) -> None:
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(model):
            if field == PIECES:
                piece = dict(_fields(value))
                self.text.append(piece.get(1, b"").decode())
                self.score.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kind.append(piece.get(3, NORMAL))
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normalizer = dict(_fields(value))
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24):
            raise ValueError("the model is no BPE with byte fallback and the space mark before words")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or set(self.kind) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model changes texts, or has pieces of the user's, in ways that are not supported")
        self.prefix = MARK if normalizer.get(3, 1) else ""
        self.scores = {t: s for t, s, k in zip(self.text, self.score, self.kind, strict=True) if k == NORMAL}
        self.bytes = [0] * 256
        for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)):
            if k == BYTE:
                self.bytes[int(t[3:5], 16)] = i
        known = sorted(set("".join(self.scores)) - {MARK})
        apart = not any(MARK in t.lstrip(MARK) for t in self.scores)
        # Letters and other characters are cut apart if no piece has one beside the other.
        neighbours = {pair for t in self.scores for pair in zip(t, t[1:], strict=False) if MARK not in pair}
        mixed = any(x.isalpha() != y.isalpha() for x, y in neighbours)
        kinds = [known] if mixed else [[c for c in known if c.isalpha()], [c for c in known if not c.isalpha()]]
        classes = ["".join(map(re.escape, kind)) for kind in kinds if kind]
        spans = "".join(f"{MARK}*[{kind}]+|" for kind in classes)
        self.cut = re.compile(f"{spans}{MARK}+|[^{''.join(classes)}{MARK}]" if apart and known else "(?s:.+)")
        self._automaton = None
        self._halves: dict[str, tuple[str, str]] = {}
        self._ordered: set[str] = set()
        #: Of a token, those it was tested with on its right, and whether both stay; and how many pairs these are.
        self._after: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self._pairs = 0
        self.runs = _Runs(self)

    def merged(self, s: str, least: int = 1) -> list[str]:
        """The merges as defined: the best score first, of equals the one furthest left; no more once ``least`` parts are left. For short
        texts; all else is tested by it."""
        parts = list(s)
        while len(parts) > least:
            best, where = None, -1
            for i, pair in enumerate(map(str.__add__, parts, parts[1:])):
                score = self.scores.get(pair)
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    @property
    def automaton(self):
        """Over the pieces that are their own encoding; what it finds is the piece's id and its length."""
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)):
                if k != NORMAL:
                    continue
                halves = self.merged(t, 2)
                if len(halves) == 2:
                    self._halves[t] = halves[0], halves[1]
                if len(halves) <= 2:
                    made.add_word(t, (i, len(t)))
            made.make_automaton()
            self._automaton = made
            # Pieces that score as no other does and less than both of their halves, which are such too: their merges come in order of scores.
            uses = Counter(self.scores.values())
            for t in sorted(self._halves, key=len):
                if uses[self.scores[t]] == 1 and all(len(h) == 1 or h in self._ordered and self.scores[h] > self.scores[t] for h in self._halves[t]):
                    self._ordered.add(t)
        return self._automaton

    def stay(self, a: str, b: str) -> bool:
        """Whether two texts that are each one token stay so together. Where merges come in order of scores, they are taken back from the last
        one, and what then lies at the boundary must have no merge that would have come first; of one piece, that is the one further
        left. The automaton has to be made."""
        scores, halves = self.scores, self._halves
        if len(a) > 1 and a not in self._ordered or len(b) > 1 and b not in self._ordered:
            return self.merged(a + b) == [a, b]
        limit, at_right = -math.inf, False
        while True:
            score = scores.get(a + b)
            if score is not None and (score > limit or at_right and score == limit):
                return False
            left, right = halves.get(a), halves.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and scores[a] < scores[b]:
                limit, at_right, a = scores[a], False, left[1]
            else:
                limit, at_right, b = scores[b], True, right[0]

    def compatible(self, left: int, right: int) -> bool:
        """Whether both stay as they are when they are encoded together. A character in no piece is ~ its code point. Remembered."""
        if self._pairs >= PAIRS:
            for after in self._after.values():  # a run that is under way holds some of them
                after.clear()
            self._pairs = 0
        self._pairs += 1
        found = self._after[left][right] = self.stay(self.text[left] if left >= 0 else chr(~left), self.text[right])
        return found

    def run_ids(self, s: str) -> tuple[int, ...]:
        """Ids of a text between cuts, in which spaces are marks."""
        n, last, at, every = len(s), [None] * (len(s) + 1), 1, self._after
        after = last.copy()  # of the last token there
        if self.automaton:
            for end, (piece, size) in self.automaton.iter(s):
                end += 1
                while at < end:  # no piece ends there, or it is one the text cannot be cut into: the character stands alone
                    if last[at] is None:
                        last[at] = ~ord(s[at - 1])
                        after[at] = every[last[at]]
                    at += 1
                if last[end] is None:
                    if size < end:
                        begin = end - size
                        stay = after[begin].get(piece)
                        if stay is None:
                            stay = self.compatible(last[begin], piece)
                        if not stay:
                            continue
                    last[end] = piece
                    after[end] = every[piece]
        while at <= n:
            if last[at] is None:
                last[at] = ~ord(s[at - 1])
            at += 1
        out: list[int] = []
        while n:
            piece = last[n]
            if piece >= 0:
                out.append(piece)
                n -= len(self.text[piece])
            else:
                out += [self.bytes[x] for x in reversed(chr(~piece).encode())]
                n -= 1
        return tuple(reversed(out))

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for run in map(self.runs.__getitem__, self.cut.findall(self.prefix + text.replace(" ", MARK))):
            out += run
        return out

    def surfaces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces one after another, where each begins, how many it has, and which take part (controls and the unknown do not)."""
        each = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(MARK, " ").encode() if k == NORMAL else b"" for t, k in zip(self.text, self.kind, strict=True)]
        sizes = np.array([len(x) for x in each], np.int64)
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array([k in (NORMAL, BYTE) for k in self.kind])

    def decoded(self, ids: list[int]) -> str:
        """The text of any ids: controls say nothing, runs of bytes that are no UTF-8 give U+FFFD a byte, the first mark goes."""
        out, run, seen = [], bytearray(), False
        for i in [*ids, None]:
            if i is not None and self.kind[i] == BYTE:
                run.append(int(self.text[i][3:5], 16))
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run, seen = bytearray(), True
            if i is None or self.kind[i] == CONTROL:
                continue
            piece = self.text[i] if self.kind[i] == NORMAL else " ⁇ "
            if not seen and self.prefix and self.kind[i] == NORMAL:
                piece, seen = piece.removeprefix(MARK), True
            seen = seen or bool(piece)
            out.append(piece.replace(MARK, " "))
        return "".join(out)


class _Runs(dict):
    """Encoded runs, remembered up to a bound."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces = pieces

    def __missing__(self, run: str) -> tuple[int, ...]:
        ids = self.pieces.run_ids(run)
        if len(run) <= RUN_CHARS:
            if len(self) >= RUNS:
                self.clear()
            self[run] = ids
        return ids


def _lenient(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in range(1, 5):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str) -> bytes:
    """A model file's bytes, checked. They are half a megabyte and go to the tasks, so executors need no file."""
    with open(path, "rb") as f:
        model = f.read()
    _pieces(model)
    return model


def encode(docs: DataFrame, model: bytes, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``, the ids of each text without those for begin and end."""
    rows = docs.withColumn(out_col, F.lit(None).cast("array<int>"))
    text_at, at = rows.columns.index(text_col), rows.columns.index(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces = _pieces(shared.value)
        for b in batches:
            texts = b.column(text_at).cast(pa.binary() if pa.types.is_string(b.column(text_at).type) else pa.large_binary())
            flat, offsets, first = [], [0], 0

            def done(end: int) -> pa.RecordBatch:
                columns = [c.slice(first, end - first) for c in b.columns]
                columns[at] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, np.int32))).cast(b.schema.field(at).type)
                return pa.RecordBatch.from_arrays(columns, b.schema.names)

            for i in range(len(texts)):
                raw = texts[i].as_py()
                flat += pieces.ids(raw.decode("utf-8", "replace")) if raw else ()
                offsets.append(len(flat))
                if len(flat) >= BATCH_TOKENS:
                    yield done(i + 1)
                    flat, offsets, first = [], [0], i + 1
            if first < b.num_rows:
                yield done(b.num_rows)

    return rows.mapInArrow(run, rows.schema)


def decode(docs: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col``, the text of each list of ids."""
    rows = docs.withColumn(out_col, F.lit(None).cast("string"))
    ids_at, at = rows.columns.index(ids_col), rows.columns.index(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces = _pieces(shared.value)
        surfaces = pieces.surfaces()
        for b in batches:
            offsets = _offsets(b.column(ids_at))
            cuts, first = [0], 0
            for i in range(1, b.num_rows):
                if offsets[i + 1] - offsets[first] > BATCH_TOKENS:
                    cuts.append(i)
                    first = i
            for a, z in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                columns = [c.slice(a, z - a) for c in b.columns]
                columns[at] = _texts(pieces, surfaces, columns[ids_at]).cast(b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _offsets(lists: pa.ListArray) -> np.ndarray:
    sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _texts(pieces: Pieces, surfaces: tuple, lists: pa.ListArray) -> pa.Array:
    """Texts of many lists of ids at once; what has other ids than pieces and bytes, or bytes that are no UTF-8, one by one."""
    blob, begins, lengths, plain = surfaces
    offsets, ids = _offsets(lists), np.array(lists.flatten(), np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths)):
        raise ValueError("an id that the model does not have")
    if plain[ids].all():
        begin, size = begins[ids], lengths[ids]
        firsts = offsets[:-1][np.diff(offsets) > 0]
        if pieces.prefix:
            marked = firsts[np.array([pieces.text[i].startswith(MARK) for i in ids[firsts]], bool)]
            begin[marked] += 1
            size[marked] -= 1
        ends = np.cumsum(size)
        where = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.concatenate([np.zeros(1, np.int64), ends])[offsets]
        out = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(blob[where].tobytes())])
        try:
            out.validate(full=True)
            return out
        except pa.ArrowInvalid:
            pass
    return pa.array([pieces.decoded(ids[a:z].tolist()) for a, z in zip(offsets, offsets[1:], strict=False)], pa.large_string())


def op12_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by the public model of 32,000 pieces, and what they decode to, as digests."""
    import public_tokenizers

    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).select("doc_id", "ids"), model)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )
