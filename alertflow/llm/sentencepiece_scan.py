"""SentencePiece encoding and decoding with a max-plus parallel scan.

Encoding is a best path over the pieces of a text. A path's weight adds up
link weights: for a unigram model the score of the piece that follows; for a
BPE model 0 if two neighbouring pieces are what merging makes of their joint
text and minus infinity if not (a segmentation is the model's encoding exactly
if all its neighbours are of this kind).

Giant documents are split into chunks of ``CHUNK`` characters, cut anywhere.
The state at a cut is the piece that lies across or ends at it. Every chunk
yields the transfer matrix of its two cuts: the best weight from each state on
the left to each state on the right, computed from the chunk and a margin of
one piece length. Matrices are combined by the max-plus product, which is
associative and gives the state at every cut; then every chunk traces its own
path back, independent of the others. Only matrices are gathered per document.

No piece spans certain places (before a space mark that follows another
character, around characters that no longer piece has). There all paths meet,
so a chunk that has such places has a matrix of rank one, and what lies
between two of them does not depend on any cut: the sentencepiece library
encodes it. Stretches at the cuts, and chunks without such a place, go through
the lattice.

Defined cases: null and empty texts have no pieces; U+2581 is the space mark
and decodes to a space; unknown characters become byte pieces (or the unknown
id if the model has none); rows are encoded one by one, so repeated rows give
equal results; an empty table gives an empty result; extra columns are ignored
by ``encode`` and kept by ``add_tokens``. Models with a normalisation other
than identity, or with user-defined pieces, are refused.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from alertflow.llm.common import free_names, read_table, staged

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; longer documents are split.
CHUNK = 16_384
#: Largest model file that is broadcast.
MAX_MODEL_BYTES = 64 << 20
MARK = "▁"
_CACHE_ROWS = 200_000
_NONE = float("-inf")
#: The state where all paths meet.
MEET = (0, 0)


class Pieces:
    """The pieces of a model: lookups, link weights, places where all paths meet."""

    def __init__(self, blob: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        self.bpe_model = trainer.model_type == 2
        if (norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or trainer.treat_whitespace_as_suffix or 4 in kinds or trainer.model_type not in (1, 2)):
            raise ValueError("only unigram and BPE models with identity normalisation and no user-defined pieces")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.ids, self.score, self.byte_ids, self.unknown = {}, {}, {}, 0
        self.raw: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            text = b""
            if p.type == 1:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                text = p.piece.replace(MARK, " ").encode()
            elif p.type == 6:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value] = i
                text = bytes([value])
            elif p.type == 2:
                self.unknown, text = i, (trainer.unk_surface or " ⁇ ").encode()
            self.raw.append(text)
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.score.values()) - 10
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        within = "[" + re.escape("".join(sorted(inner - {MARK}))) + "]"
        outside = "[^" + re.escape("".join(sorted(inner | {MARK}))) + "]"
        split_at_mark = not any(c == MARK and before != MARK for p in self.ids for before, c in pairwise(p))
        self.unit = re.compile(f"{MARK}+{within}*|{within}+|{outside}" if split_at_mark
                               else f"(?:{MARK}|{within})+|{outside}")
        proto.normalizer_spec.add_dummy_prefix = False
        self.library = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.links: dict[tuple[str, str], float] = {}
        self.whole: dict[str, bool] = {}

    def normalised(self, text: str | None) -> str:
        return self.prefix + text.replace(" ", MARK) if text else ""

    def meetings(self, text: str, at_start: bool) -> list[int]:
        """Places where all paths meet; the first one only if the text starts where a document does."""
        found = [m.start() for m in self.unit.finditer(text)]
        return found if at_start else found[1:]

    def encode_between(self, text: str) -> list[int]:
        """Ids of a stretch that begins and ends where all paths meet."""
        return self.library.encode(text, num_threads=1) if text else []

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scoring neighbours merge first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(self.score[a + b], -i) for i, (a, b) in enumerate(pairwise(parts)) if a + b in self.score]
            if not scored:
                break
            i = -max(scored)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces (or one unknown character) with which a path can go on at a place."""
        out = []
        for n in range(1, min(self.longest, len(text) - at) + 1):
            piece = text[at:at + n]
            if n == 1 or (piece in self.ids and self.is_whole(piece)):
                out.append(piece)
        return out

    def is_whole(self, piece: str) -> bool:
        if not self.bpe_model:
            return True
        if piece not in self.whole:
            self.whole[piece] = self.merged(piece) == [piece]
        return self.whole[piece]

    def link(self, left: str, right: str) -> float:
        """Weight of ``right`` after ``left`` ('' where all paths meet)."""
        if not self.bpe_model:
            return self.score.get(right, self.unknown_score)
        if not left:
            return 0.0
        pair = (left, right)
        if pair not in self.links:
            if len(self.links) >= _CACHE_ROWS:
                self.links.clear()
            self.links[pair] = 0.0 if self.merged(left + right) == [left, right] else _NONE
        return self.links[pair]

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    # -- the lattice between two cuts

    def paths(self, text: str, entries: list[tuple[int, int]], stop: int) -> dict[tuple[int, int], tuple[list, list]]:
        """Best weights from each entry piece (its first place and end; an empty one where paths meet) to every
        piece (first, end) up to those that reach ``stop``: (weights, previous pieces), one per entry."""
        nodes: dict[tuple[int, int], tuple[list, list]] = {}
        ending: dict[int, list[tuple[int, int]]] = {}
        for k, e in enumerate(entries):
            nodes[e] = ([0.0 if j == k else _NONE for j in range(len(entries))], [None] * len(entries))
            ending.setdefault(e[1], []).append(e)
        for at in range(min((e[1] for e in entries), default=stop), stop):
            before = ending.get(at)
            if not before:
                continue
            for piece in self.starting(text, at):
                best, back = [_NONE] * len(entries), [None] * len(entries)
                for p in before:
                    w = self.link(text[p[0]:p[1]], piece)
                    if w > _NONE:
                        for k, v in enumerate(nodes[p][0]):
                            if v + w > best[k]:
                                best[k], back[k] = v + w, p
                if max(best) > _NONE:
                    node = (at, at + len(piece))
                    nodes[node] = (best, back)
                    ending.setdefault(node[1], []).append(node)
        return nodes

    def crossing(self, text: str, cut: int) -> list[tuple[int, int]]:
        """All pieces that contain the character before the cut."""
        return [(i, i + len(p)) for i in range(max(0, cut - self.longest), cut) for p in self.starting(text, i)
                if i + len(p) >= cut]


class Chunk:
    """A chunk's text with its margins; places are counted from the margin's start."""

    def __init__(self, pieces: Pieces, left: str, body: str, right: str, first: bool, last: bool):
        self.pieces, self.text = pieces, left + body + right
        self.lo, self.hi = len(left), len(left) + len(body)
        self.meet = pieces.meetings(self.text, first)
        if last:
            self.meet.append(self.hi)
        inside = [m for m in self.meet if self.lo <= m <= self.hi]
        self.head, self.tail = (inside[0], inside[-1]) if inside else (None, None)

    def _states(self, cut: int) -> list[tuple[int, int]]:
        return [(cut, cut)] if cut in (self.head, self.tail) and cut in self.meet else self.pieces.crossing(self.text, cut)

    @staticmethod
    def _ends(nodes, stop):
        return [n for n in nodes if n[0] < stop <= n[1] or n == (stop, stop)]

    def matrix(self) -> dict[tuple[tuple, tuple], float]:
        """Weights by (state on the left, state on the right); a state is a piece's (first, end) from the cut."""
        if self.head is None:
            entries = self._states(self.lo)
            return self._between(entries, self.lo, self.hi)
        left = self._between(self._states(self.lo), self.lo, self.head, meet_at_end=True)
        right = self._between([(self.tail, self.tail)], self.tail, self.hi, meet_at_end=self.tail == self.hi)
        return {(a, b): v + w for (a, _), v in left.items() for (_, b), w in right.items()}

    def _between(self, entries, lo: int, hi: int, meet_at_end: bool = False) -> dict:
        """Weights from entries at ``lo`` to the pieces at ``hi`` (all in one if paths meet there)."""
        nodes, out = self.pieces.paths(self.text, entries, hi), {}
        for n in self._ends(nodes, hi):
            if meet_at_end and n[1] != hi:
                continue
            for e, w in zip(entries, nodes[n][0], strict=True):
                key = (self._state(e, lo), MEET if meet_at_end else self._state(n, hi))
                if w > out.get(key, _NONE):
                    out[key] = w
        return out

    @staticmethod
    def _state(piece: tuple[int, int], cut: int) -> tuple[int, int]:
        return MEET if piece == (cut, cut) else (piece[0] - cut, piece[1] - cut)

    def trace(self, entry: tuple, leave: tuple) -> list[int]:
        """Ids of the pieces that begin in this chunk, on the best path between two states."""
        start = (self.lo + entry[0], self.lo + entry[1])
        end = (self.hi + leave[0], self.hi + leave[1])
        if self.head is None:
            return self._back(start, self.hi, end)
        out = self._back(start, self.head, None)
        out += self.pieces.encode_between(self.text[self.head:self.tail])
        return out + (self._back((self.tail, self.tail), self.hi, end) if self.tail < self.hi else [])

    def _back(self, start, stop: int, end) -> list[int]:
        nodes = self.pieces.paths(self.text, [start], stop)
        if end is None or end == (stop, stop):  # paths meet at the stop: the best piece that ends there
            at = max((n for n in nodes if n[1] == stop), key=lambda n: nodes[n][0][0])
        else:
            at = end
        chain = []
        while at != start:
            chain.append(at)
            at = nodes[at][1][0]
        return [i for a, b in reversed(chain) for i in self.pieces.piece_ids(self.text[a:b])]


def combine(one: dict, two: dict) -> dict:
    """Max-plus product of two transfer matrices."""
    by_left: dict = {}
    for (a, b), w in two.items():
        by_left.setdefault(a, []).append((b, w))
    out: dict = {}
    for (a, b), v in one.items():
        for c, w in by_left.get(b, ()):
            if v + w > out.get((a, c), _NONE):
                out[a, c] = v + w
    return out


def states_at_cuts(matrices: list[dict]) -> list[tuple[tuple, tuple]]:
    """For every chunk the states at its two cuts on the best path of the whole document."""
    before = list(accumulate(matrices, combine))
    after = list(accumulate(reversed(matrices), lambda two, one: combine(one, two)))[::-1]
    cuts = [MEET]
    for k in range(len(matrices) - 1):
        left = {b: w for (a, b), w in before[k].items() if a == MEET}
        right = {a: w for (a, b), w in after[k + 1].items() if b == MEET}
        cuts.append(max((s for s in left if s in right), key=lambda s: left[s] + right[s]))
    cuts.append(MEET)
    return list(pairwise(cuts))


_loaded: dict[int, Pieces] = {}


def _pieces(shared) -> Pieces:
    """One model per worker process."""
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(shared.value)
    return _loaded[key]


def _broadcast(spark: SparkSession, model_path: str):
    with open(model_path, "rb") as f:
        blob = f.read(MAX_MODEL_BYTES + 1)
    if len(blob) > MAX_MODEL_BYTES:
        raise ValueError(f"{model_path} is larger than the {MAX_MODEL_BYTES} bytes that are broadcast")
    Pieces(blob)  # refuses what cannot be encoded before any job starts
    return spark.sparkContext.broadcast(blob)


def chunk_rows(docs: DataFrame, shared, chunk: int) -> DataFrame:
    """row, part, parts, left margin, body, right margin of every document of more than ``chunk`` characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared)
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                norm = p.normalised(text)
                parts, m = -(-len(norm) // chunk), 2 * p.longest
                for first in range(0, parts, 64):
                    lows = range(first * chunk, min((first + 64) * chunk, len(norm)), chunk)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(lows), pa.int64()), pa.array([lo // chunk for lo in lows], pa.int64()),
                         pa.array([parts] * len(lows), pa.int64()),
                         pa.array([norm[max(0, lo - m):lo] for lo in lows], pa.string()),
                         pa.array([norm[lo:lo + chunk] for lo in lows], pa.string()),
                         pa.array([norm[lo + chunk:lo + chunk + m] for lo in lows], pa.string())],
                        names=["row", "part", "parts", "before", "body", "after"])

    return docs.select("row", "text").mapInArrow(
        run, "row long, part long, parts long, before string, body string, after string")


def _chunks(b: pa.RecordBatch, p: Pieces) -> Iterator[Chunk]:
    cols = [b.column(n).to_pylist() for n in ("part", "parts", "before", "body", "after")]
    for part, parts, before, body, after in zip(*cols, strict=True):
        # a margin shorter than asked for reaches back to the document's start
        yield Chunk(p, before, body, after, len(before) < 2 * p.longest, part == parts - 1)


def encode_giant(docs: DataFrame, shared, chunk: int) -> DataFrame:
    """row, token_ids of documents (row, text) that are split into chunks."""
    # written as they come: the file's row groups, not the documents, are what the next stages are dealt by
    chunks = staged(chunk_rows(docs, shared, chunk), "pieces-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("part"), pa.array([pickle.dumps(c.matrix()) for c in _chunks(b, p)], pa.binary())],
                names=["row", "part", "matrix"])

    def solve(table):
        table = table.sort_by("part")
        states = states_at_cuts([pickle.loads(m) for m in table["matrix"].to_pylist()])
        flat = np.array([[*a, *b] for a, b in states], np.int64)
        return pa.table({"row": table["row"], "part": table["part"],
                         **{n: pa.array(flat[:, i]) for i, n in enumerate(("l0", "l1", "r0", "r1"))}})

    transfer = chunks.mapInArrow(matrices, "row long, part long, matrix binary")
    states = transfer.groupBy("row").applyInArrow(solve, "row long, part long, l0 long, l1 long, r0 long, r1 long")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared)
        for b in batches:
            ends = zip(*(b.column(n).to_pylist() for n in ("l0", "l1", "r0", "r1")), strict=True)
            ids = [c.trace((l0, l1), (r0, r1)) for c, (l0, l1, r0, r1) in zip(_chunks(b, p), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("part"), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["row", "part", "ids"])

    traced = chunks.join(states, ["row", "part"]).mapInArrow(trace, "row long, part long, ids array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("part", "ids")))
    return traced.groupBy("row").agg(F.flatten(in_order["ids"]).alias("token_ids"))


def add_tokens(docs: DataFrame, text_col: str = "text", model_path: str = MODEL_PATH, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with a column token_ids (array<int>), which they must not have yet. Documents of up to ``chunk`` characters
    are encoded where they are; only longer ones are split and meet again by row."""
    if "token_ids" in map(str.lower, docs.columns):
        raise ValueError("the documents already have a column token_ids")
    row, = free_names(docs, "piece_row")
    shared = _broadcast(docs.sparkSession, model_path)
    names, is_giant = docs.columns, F.coalesce(F.length(F.col(text_col)) > chunk, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = _pieces(shared), names.index(text_col)
        for b in batches:
            for lo in range(0, b.num_rows, 512):  # token lists are larger than their texts
                part = b.slice(lo, 512)
                ids = pa.array([np.array(p.encode_between(p.normalised(t)), np.int32) for t in part.column(at).to_pylist()],
                               pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*names, "token_ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    short = docs.filter(~is_giant).mapInArrow(run, f"{fields}, token_ids array<int>")
    giant = staged(docs.filter(is_giant).withColumn(row, F.monotonically_increasing_id()), "pieces-giant")
    tokens = encode_giant(giant.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text")), shared, chunk)
    long = giant.join(tokens.withColumnRenamed("row", row), row)
    return short.union(long.select(*[F.col(f"`{c}`") for c in names], "token_ids"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Per document: id, token_ids."""
    return add_tokens(docs.select(id_col, text_col), text_col, **params).drop(text_col)


def decode(tokens: DataFrame, ids_col: str = "token_ids", model_path: str = MODEL_PATH) -> DataFrame:
    """``tokens`` with a column decoded (text)."""
    shared, names = _broadcast(tokens.sparkSession, model_path), tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = _pieces(shared), names.index(ids_col)
        for b in batches:
            texts = [p.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{fields}, decoded string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(add_tokens(docs))
    text = F.coalesce(F.replace("text", F.lit(MARK), F.lit(" ")), F.lit(""))
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                       (F.col("decoded") == text).alias("round_trip"))
