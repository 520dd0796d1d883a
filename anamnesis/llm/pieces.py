"""SentencePiece encoding and decoding of a merge-type (BPE) model.

A text is cut into chunks before each space that follows another character; no
piece of the vocabulary crosses such a place, which is checked when the model
is loaded. A chunk is encoded by backtracking: an Aho-Corasick automaton gives
every piece that ends at a place, hence the pieces that begin at one, longest
first; a piece may follow another only if merging the two pieces' characters
anew gives back exactly these two; a bitfield holds the places from which the
rest cannot be encoded. Characters without a piece become byte pieces.

Defined cases: null or empty text is the end id alone; decoding drops control
ids and the space put in front, and shows undecodable bytes as U+FFFD; repeated
rows each give their row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Callable
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import map_texts, table

SPACE = "▁"
#: Chunks whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    """The vocabulary of a model file, and encoding and decoding with it."""

    def __init__(self, proto: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only merge-type models with identity normalisation are read")
        self.front = SPACE if rules.add_dummy_prefix else ""
        kinds = [p.type for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("a piece goes on over a space")
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes = [byte_ids.get(b, self.unknown) for b in range(256)]
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.raw = [b"" if k == _CONTROL else bytes([int(p.piece[3:5], 16)]) if k == _BYTE else model.trainer_spec.unk_surface.encode() if k == _UNKNOWN else p.piece.replace(SPACE, " ").encode() for p, k in zip(model.pieces, kinds, strict=True)]
        self.spaced = {i for p, i in self.id.items() if p.startswith(SPACE)}
        self.say = [str(i) for i in range(len(kinds))]
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if self.merge(p) == [p]:  # others are never the outcome of merging
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """Merge characters by best score, leftmost first; for short strings."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether re-merging the two pieces' characters leaves the border in place."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def backtrack(self, chunk: str) -> list[str]:
        """The pieces of a chunk, a character without a piece standing for itself."""
        n = len(chunk)
        starting: list[list[str]] = [[] for _ in range(n)]
        for last, piece in self.automaton.iter(chunk):
            starting[last - len(piece) + 1].append(piece)
        for i, found in enumerate(starting):
            if not found:
                found.append(chunk[i])
            elif len(found) > 1:
                found.reverse()  # they came by growing end, so this is longest first
        failed = 0  # bit i: nothing that ends at i goes on to the end
        path: list[str] = []
        tried: list[int] = []
        at, nth = 0, 0
        while at < n:
            choices = starting[at]
            while nth < len(choices):
                piece = choices[nth]
                if not failed >> (at + len(piece)) & 1 and (not path or self.fits(path[-1], piece)):
                    break
                nth += 1
            else:
                if not path:
                    raise ValueError("no encoding found")
                failed |= 1 << at
                at -= len(path.pop())
                nth = tried.pop() + 1
                continue
            path.append(piece)
            tried.append(nth)
            at += len(piece)
            nth = 0
        return path

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        if (whole := self.id.get(chunk)) is not None and chunk in self.automaton:
            return (whole,)
        out: list[int] = []
        for piece in self.backtrack(chunk):
            i = self.id.get(piece)
            if i is None:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, the end id last."""
        if not text:
            return [self.end]
        chunks = _CHUNK.findall(self.front + text.replace(" ", SPACE))
        known = self.known
        try:
            return [*chain.from_iterable(map(known.__getitem__, chunks)), self.end]
        except KeyError:
            new = set(chunks).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(chunks)
            for c in new:
                known[c] = self.chunk_ids(c)
            return [*chain.from_iterable(map(known.__getitem__, chunks)), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = _decode_damaged(raw)
        lead = next((i for i in ids if self.raw[i]), None)
        return text[1:] if lead is not None and self.front and lead in self.spaced else text


def _decode_damaged(raw: bytes) -> str:
    """UTF-8 with each byte that begins no whole character shown as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _row(model: PieceModel) -> Callable[[str], tuple]:
    def row(text: str) -> tuple:
        ids = model.encode(text)
        said = " ".join(map(model.say.__getitem__, ids))
        back = model.decode(ids)
        return ids, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()

    return row


def worker_model(proto: bytes) -> PieceModel:
    """The model, kept with what it remembers while the worker process lives."""
    held = sys.modules.setdefault("_pieces_of_this_worker", types.ModuleType("_pieces_of_this_worker"))
    name = "m" + hashlib.sha256(proto).hexdigest()
    if not hasattr(held, name):
        setattr(held, name, PieceModel(proto))
    return getattr(held, name)


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = True) -> DataFrame:
    """A row for each document: its ids, their count, and digests of ids and decoded text.

    The model file is read once, on the driver, and travels with the tasks; its
    size is that of a vocabulary, whatever the corpus.
    """
    with open(model_file, "rb") as f:
        proto = f.read()
    if len(proto) > 64 << 20:
        raise ValueError("a model file over 64 MB is not sent with tasks")
    held = docs.sparkSession.sparkContext.broadcast(proto)

    def start() -> Callable[[str], tuple]:
        row = _row(worker_model(held.value))
        return row if with_ids else lambda text: row(text)[1:]

    tail = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, start, f"ids array<int>, {tail}" if with_ids else tail)


def default_model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_model_file(), with_ids=False)
