"""Token ids of texts by a public byte-level tokenizer."""

from __future__ import annotations

import base64
import re

import numpy as np

#: Texts of these characters alone give the same ids by either library.
_PLAIN = re.compile(r"[\n\x20-\x7e¡-¬®-ÿ]*")
_loaded: dict[tuple[str, str | None], ByteTokens] = {}


class ByteTokens:
    """The ids that `tokenizers` gives with the file at path.

    ranks_path: the same vocabulary as ranks; plain texts then take the faster library, but for
    those that hold the name of an added token, which is one id wherever it stands.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        names = self.slow.get_vocab(with_added_tokens=True)
        size = max(names.values()) + 1
        self.ends, self.leads = np.zeros(size, bool), np.zeros(size, bool)
        for name, i in names.items():  # the vocabulary writes a blank as Ġ and a line end as Ċ
            self.ends[i] = "Ċ" in name or name.rstrip("\"')]}»”").endswith((".", "!", "?"))
            self.leads[i] = name[0] in "ĠĊ"

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit bytes."""
        if self.fast is not None and _PLAIN.fullmatch(text) and not (self.added and self.added.search(text)):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Whether a sentence ends after each id: at its mark, if a blank or the end follows."""
        found = self.ends[ids]
        found[:-1] &= self.leads[ids[1:]] | (ids[1:] == 0)
        return found


def tokens(path: str | None = None, ranks_path: str | None = None) -> ByteTokens:
    """The worker's tokenizer; the public 50k byte-level vocabulary unless another path is given."""
    if path is None:
        import public_tokenizers

        path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    if (path, ranks_path) not in _loaded:
        _loaded[path, ranks_path] = ByteTokens(path, ranks_path)
    return _loaded[path, ranks_path]
