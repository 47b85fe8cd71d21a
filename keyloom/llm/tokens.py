"""The ids of the public byte-level BPE vocabulary. The rank file and the tokenizer file hold the same vocabulary and give the
same ids (tests compare them); ranks are several times faster, so they are used here."""

from __future__ import annotations

import base64
import functools

#: The special token of the public vocabularies, a fixed value of theirs.
SPECIAL = {"<|endoftext|>": 50256}


@functools.cache
def encoder(vocabulary: str = "byte_bpe_50k", special: bool = False):
    """A function from text to ids. `special`: strings of special tokens get their own ids, as the tokenizer file does by itself;
    otherwise they are ordinary text. `vocabulary`: a name or a path without its ending."""
    import public_tokenizers as public
    import tiktoken

    path = f"{vocabulary}.tiktoken" if "/" in vocabulary else public.path(f"{vocabulary}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    coder = tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return functools.partial(coder.encode, allowed_special="all") if special else coder.encode_ordinary
