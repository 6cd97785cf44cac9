"""Public tokenizer files; their folder is a parameter (LODESTONE_TOKENIZERS or the argument)."""

from __future__ import annotations

import base64
import functools
import os

DEFAULT_FOLDER = "/opt/tokenizers"


def tokenizer_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("LODESTONE_TOKENIZERS", DEFAULT_FOLDER), name)


def sentencepiece_pieces(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) in the order of ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path("piece_bpe_32k.model"))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


@functools.lru_cache(2)
def tiktoken_encoding(path: str | None = None):
    """Byte-level BPE of the ranks file; once per process."""
    import tiktoken

    with open(path or tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # the split pattern of byte-level BPE (a fixed value)
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_pieces(path: str | None = None) -> list[str]:
    """Pieces of a byte-level vocabulary for many languages that are whole characters, without the blanks around them, by rank."""
    with open(path or tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranked = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
    out = []
    for _, piece in ranked:
        try:
            word = piece.decode("utf-8").strip()
        except UnicodeDecodeError:
            continue  # a part of a character
        if word:
            out.append(word)
    return out
