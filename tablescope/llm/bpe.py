"""BPE encoding and decoding as streaming transducers with bounded lookahead.

From the merge list alone follows how many symbols beyond the end of a token can still change it: a token is only undone
by a merge with its right neighbour, that neighbour is only there if it was not taken by its own right neighbour at a
smaller rank, and so on along ever smaller ranks.  `lookahead` adds up the longest such chain.  The encoder therefore
holds at most a window of symbols, emits each token that lies further left than the lookahead, and starts afresh behind
it.  The decoder turns tokens into text through a byte state machine that holds at most one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched, chain, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablescope.llm.common import by_text
from tablescope.llm.counts import byte_alphabet

MOST_PIECES = 200_000
BLOCK = 4096


def lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols to the right of a token's end that can change it, at most; 0 without merges.

    ``reach[v]``: over all merges so far, how far to the right of v lies what decides whether v is still there.
    Going through the merges by rank, (v, w) makes v depend on w being there, that is on w's own reach before this
    rank; the merged token inherits the reach of its right part.
    """
    reach: dict[str, int] = {}
    for v, w in merges:
        of_w = reach.get(w, 0)
        whole = v + w
        reach[whole] = max(reach.get(whole, 0), of_w)
        reach[v] = max(reach.get(v, 0), length[w] + of_w)
    return max(reach.values(), default=0)


class Merger:
    """Merges of one vocabulary over lists of symbols."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int]):
        self.ids = vocabulary
        ids = vocabulary
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.made = [ids[a + b] for a, b in merges]
        self.none = len(merges)

    def merge(self, symbols: list[int]) -> list[int]:
        """The lowest rank first, leftmost first within a rank."""
        parts, rank, made, none = symbols.copy(), self.rank, self.made, self.none
        ranks = [rank.get(p, none) for p in pairwise(parts)]
        while ranks:
            lowest = min(ranks)
            if lowest == none:
                break
            i = ranks.index(lowest)
            token = parts[i] = made[lowest]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], token), none)
            if i < len(ranks):
                ranks[i] = rank.get((token, parts[i + 1]), none)
        return parts


class Encoder:
    """The streaming encoder of a word-end BPE file: lower case, NFC, white space dropped, special strings kept whole."""

    def __init__(self, path: str, window: int | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids: dict[str, int] = {**model["vocab"], **self.special}
        self.merger = Merger(merges, self.ids)
        suffix = self.suffix
        self.width = {t: max(1, len(t.removesuffix(suffix) if suffix else t)) for t in model["vocab"]}
        self.lookahead = lookahead(merges, self.width)
        # the window: what may still change, and one token that is complete in front of it
        self.window = window or self.lookahead + max(self.width.values()) + 1
        self.wide = {i: self.width.get(t, len(t)) for t, i in self.ids.items()}
        back = {b: c for c, b in byte_alphabet().items()}
        self.inner = [self.ids[back[b]] for b in range(256)]
        self.last = [self.ids[back[b] + suffix] for b in range(256)]
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
        )
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def tokens(self, piece: Iterable[int]) -> Iterator[int]:
        """Ids of one piece given byte by byte.  Holds a window of symbols, whatever the piece's length."""
        final, ahead = self.window + self.window, self.lookahead
        if isinstance(piece, bytes) and len(piece) <= final:
            inner = self.inner
            yield from self.merger.merge([*[inner[b] for b in piece[:-1]], self.last[piece[-1]]])
            return
        held: list[int] = []
        before = -1
        for byte in piece:
            if before >= 0:
                held.append(self.inner[before])
            before = byte
            if len(held) >= final:
                stable = len(held) - ahead
                done = 0
                for token in self.merger.merge(held):
                    if done + self.wide[token] > stable:
                        break
                    done += self.wide[token]
                    yield token
                held = held[done:]
        if before >= 0:
            held.append(self.last[before])
            yield from self.merger.merge(held)

    def pieces(self, text: str) -> Iterator[list[str | int]]:
        """Pieces of the normalised text in order, in blocks; special strings as their ids."""
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                yield [self.special[part]]
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = "".join([c.lower() for c in part]) if "Σ" in part else part.lower()
                found = (m.group() for m in self.pattern.finditer(part))
                yield from batched(found, BLOCK) if len(part) > 1_000_000 else [self.pattern.findall(part)]

    def encode(self, text: str) -> Iterator[int]:
        for piece in chain.from_iterable(self.pieces(text)):
            if isinstance(piece, int):
                yield piece
            else:
                yield from self.tokens(piece.encode("utf-8", "surrogatepass"))


class Decoder:
    """Text of a stream of ids, a piece of text at a time.

    The state is whether anything was written and the bytes of an unfinished character.  Without a decoder in the file
    tokens are written as they are named, with a space between; a byte-level decoder writes their bytes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no state machine for the decoder {kind}")
        self.between = b" " if kind is None else b""
        special = {t["content"] for t in spec["added_tokens"]}
        vocabulary = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            plain = kind is None or token in special
            self.bytes[i] = token.encode() if plain else bytes(letters[c] for c in token)
        self.reset()

    def reset(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        """What is certain after these ids."""
        return self.feed_bytes(self.bytes_of(ids))

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        table = self.bytes
        return self.between.join([table[i] for i in ids])

    def feed_bytes(self, block: bytes) -> str:
        if not block:
            return ""
        lead = self.between if self.begun else b""
        self.begun = True
        return self.machine.decode(lead + block)

    def finish(self) -> str:
        rest = self.machine.decode(b"", True)
        self.reset()
        return rest


@lru_cache(maxsize=1)
def machines(path: str) -> tuple[Encoder, Decoder, dict]:
    """(encoder, decoder, pieces met so far) of a worker process; they serve one task after the other."""
    return Encoder(path), Decoder(path), {}


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ids (array of int) of every text; null and empty text give an empty array.  No shuffle."""

    def work():
        encoder = Encoder(path)
        return lambda texts: {"ids": pa.array([list(encoder.encode(t)) for t in texts], pa.list_(pa.int32()))}

    return by_text(docs, key, text, work, "ids array<int>")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, ids_sha256 and decoded_sha256 of every text, and n_decoded (characters of the decoded text).

    ``path`` is a tokenizer file with word ends that every worker has.  Ids go from the encoder into the decoder and both
    into running digests, a block at a time.  Null and empty text have no ids (digests of nothing); repeated rows and rows
    without a key keep their row; other columns are not read.  One pass, no shuffle.
    """

    def work():
        encoder, decoder, known = machines(path)

        def piece_ids(piece: str | int) -> tuple[str, int, bytes]:
            ids = [piece] if isinstance(piece, int) else list(encoder.tokens(piece.encode("utf-8", "surrogatepass")))
            found = (" ".join(map(str, ids)), len(ids), decoder.bytes_of(ids))
            if len(known) >= MOST_PIECES:
                known.clear()
            if isinstance(piece, int) or len(piece) <= encoder.window:
                known[piece] = found
            return found

        def act(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "n_decoded": []}
            for t in texts:
                of_ids, of_text, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                decoder.reset()
                for block in encoder.pieces(t):
                    if not block:
                        continue
                    found = [known.get(p) or piece_ids(p) for p in block]
                    of_ids.update(((" " if n else "") + " ".join([f[0] for f in found])).encode())
                    n += sum([f[1] for f in found])
                    some = decoder.feed_bytes(decoder.between.join([f[2] for f in found]))
                    chars += len(some)
                    of_text.update(some.encode("utf-8", "surrogatepass"))
                rest = decoder.finish()
                of_text.update(rest.encode())
                out["n_tokens"].append(n)
                out["ids_sha256"].append(of_ids.hexdigest())
                out["decoded_sha256"].append(of_text.hexdigest())
                out["n_decoded"].append(chars + len(rest))
            return out

        return act

    return by_text(docs, key, text, work, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_decoded long")
