"""Where the public tokenizer files are."""

from __future__ import annotations


def byte_bpe() -> str:
    """The byte-level BPE tokenizer of 50,257 ids; it is installed, not part of this library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
