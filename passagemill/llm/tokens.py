"""Token ids of whole texts by a public tokenizer file, fast enough to tokenize a corpus.

The file word_bpe_49k.json drops white space between words and never joins across it, so a text's ids are those of its
space-separated chunks in turn; chunks repeat, and are cached, and so are their pieces. A chunk of Latin letters and ASCII is cut and merged by the ranks
of the same file; any other goes to the tokenizer itself. Tests hold both against the tokenizer.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa

#: Most chunks that a worker keeps.
CACHE = 400_000
_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
#: What the file's pattern does to such chunks in lower case.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: Characters that normalisation leaves alone and whose lower case is one such letter.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunks(dict):
    """Little-endian 32-bit ids by chunk."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        vocab = json.loads(open(path, encoding="utf-8").read())["model"]["vocab"]
        byte = {c: b for b, c in _byte_names().items()}
        #: The end of a word is byte 255, which UTF-8 never holds, so that ranks by bytes are the file's ids.
        ranks = {}
        for word, i in vocab.items():
            end = word.endswith("</w>") and len(word) > 4
            ranks[bytes(byte[c] for c in (word[:-4] if end else word)) + b"\xff" * end] = i
        ranks[b"\xff"] = 1 << 30
        self.pieces: dict[str, bytes] = {}
        self.merge = tiktoken.Encoding("words", pat_str=r".", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)._core_bpe.encode_single_piece

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN(chunk) and "<|" not in chunk:
            known, out = self.pieces, b""
            for piece in _PIECE.findall(chunk.lower()):
                ids = known.get(piece)
                if ids is None:
                    if len(known) >= CACHE // 2:
                        known.clear()
                    known[piece] = ids = array("I", self.merge(piece.encode() + b"\xff")).tobytes()
                out += ids
        else:
            out = array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = out
        return out

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, _CHUNK.findall(text))) if text else b""


def _byte_names() -> dict[int, str]:
    """The printable characters that stand for bytes in such files: themselves if visible in Latin-1, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_open: dict[str, Chunks] = {}


def chunks(path: str) -> Chunks:
    """One cache per worker and file."""
    if path not in _open:
        _open[path] = Chunks(path)
    return _open[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    ids = chunks(path)
    for batch in batches:
        yield batch, [ids.text(x) for x in batch[column].to_pylist()]
