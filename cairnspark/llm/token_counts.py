"""Token counts of whole texts by a public tokenizer, with overlap resynchronisation for huge texts.

A text of at most `chunk_chars` is encoded at once by the library. A longer one is cut into chunks that overlap; each is
encoded with its tokens' offsets, and two neighbours are spliced at a boundary of tokens that both have in the overlap
and that is proven stable. When there is none, the overlap is widened, and a chunk that needs it reads on.

Stable boundaries, for byte-level BPE:

* Between pieces of the pre-tokenizer. Its pattern is matched from left to right without looking back, so once two scans
  both begin a piece at a place, they go on alike; merges stay within pieces. A piece's end may depend on the character
  after it, so the last piece of a cut chunk proves nothing, nor does a place within the length of a special string
  from where one stands.
* Within a piece that is longer than an overlap (a run of letters without blanks, say). Tokens are BPE's encoding of a
  string if and only if each two neighbours are the encoding of their two strings joined, as any merge that could come
  first shows in such a pair. Both chunks' tokens meet this already; so a splice is right when the last token before it
  and the first token after it do, which the library is asked.

Bounded memory: a chunk and its overlap are held at a time; a piece without any boundary is spliced as well.

Null text: empty, 0 tokens. Empty text: 0. Null ids: rows as others. Repeated rows: a row each. Empty table: no rows.
Extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 256
#: Where a piece ends depends on fewer characters after it than this (three, for the contractions of byte-level BPE).
LOOK_AHEAD = 16
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """The library's tokenizer, without truncation, padding, begin and end tokens."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.reach = max(map(len, self.special), default=0)
        self.ahead = max(self.reach, LOOK_AHEAD)

    def counts(self, texts: list[str]) -> list[int]:
        return list(map(len, self.library.encode_batch_fast(texts, add_special_tokens=False)))

    def tokens(self, text: str) -> tuple[list[int], list[int], set[int]]:
        """Ids, where each token begins (its first character), and where pieces begin."""
        e = self.library.encode(text, add_special_tokens=False)
        words = e.word_ids
        begins = [a for a, _ in e.offsets]
        return e.ids, begins, {begins[i] for i in range(len(words)) if i == 0 or words[i] != words[i - 1]}

    def near_special(self, text: str, at: int) -> bool:
        """Whether a special string stands around a place, or might begin or end there."""
        around = text[max(0, at - self.reach) : at + self.reach]
        return any(s in around for s in self.special)

    def joined(self, left: int, right: int, text: str) -> bool:
        """Whether these two tokens, which stand for `text`, are its encoding."""
        return self.library.encode(text, add_special_tokens=False).ids == [left, right]


def _splice(encoder: Encoder, text: str, start: int, end: int, one: tuple, nxt: int, stop: int, two: tuple) -> tuple[int, int, int] | None:
    """The last place where the tokens of text[start:end] may go over to those of text[nxt:stop], and how many tokens stand before it in both; None if no place is proven."""
    ids, begins, pieces = one
    ids2, begins2, pieces2 = two
    there = {b: k for k, b in enumerate(begins2) if k and b > begins2[k - 1]}
    for k in range(len(begins) - 1, 0, -1):
        at = begins[k] + start
        if at <= nxt:
            return None
        other = there.get(at - nxt)
        if other is None or begins[k] == begins[k - 1] or encoder.near_special(text, at):
            continue
        if begins[k] in pieces and at - nxt in pieces2:
            if end - at > encoder.ahead:
                return at, k, other
        elif begins[k] not in pieces and at - nxt not in pieces2:
            after = begins2[other + 1] + nxt if other + 1 < len(begins2) else stop
            # characters of several tokens: their strings aren't these tokens' own, and the answer is no
            if encoder.joined(ids[k - 1], ids2[other], text[begins[k - 1] + start : after]):
                return at, k, other
    return None


def spliced_count(encoder: Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a text from overlapping chunks of `chunk` characters."""
    if len(text) <= chunk:
        return encoder.counts([text])[0]
    total, start, end = 0, 0, chunk
    one = encoder.tokens(text[:end])
    while end < len(text):
        width, met = min(overlap, end - start - 1), None
        while met is None:
            nxt = end - width
            stop = min(len(text), end + max(1, chunk - width))
            two = encoder.tokens(text[nxt:stop])
            met = _splice(encoder, text, start, end, one, nxt, stop, two)
            if width >= end - start - 1:
                break
            width = min(2 * width + 1, end - start - 1)
        if met is None:  # nothing is proven in a whole chunk: read on, as one longer chunk
            end = min(len(text), end + (end - start))
            one = encoder.tokens(text[start:end])
            continue
        at, mine, theirs = met
        total += mine
        ids, begins, pieces = two
        shift = at - nxt
        one = ids[theirs:], [b - shift for b in begins[theirs:]], {b - shift for b in pieces if b >= shift}
        start, end = at, stop
    return total + len(one[0])


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row for each row: id, n_bytes (UTF-8), n_tokens. Map-only: no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        encoder = _encoder(tokenizer_path)
        for b in batches:
            texts = [x or "" for x in b.column(2).to_pylist()]
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if t and len(t) <= chunk_chars]
            for k in range(0, len(short), 256):
                own = short[k : k + 256]
                for i, n in zip(own, encoder.counts([texts[i] for i in own])):
                    counts[i] = n
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    counts[i] = spliced_count(encoder, t, chunk_chars, overlap_chars)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
