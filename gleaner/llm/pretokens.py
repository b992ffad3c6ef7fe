"""Pre-tokens: the pieces of a text that no merge of a byte-pair vocabulary crosses."""
from __future__ import annotations

import re
from collections.abc import Callable

import regex

from gleaner.llm.common import by_value

by_value(__name__)

# The pattern that byte-level tokenizers without one of their own use.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Character classes differ between versions of Unicode. In these blocks all code points were
# assigned long ago; a text with any other is cut by the tokenizer's library.
UNSETTLED = regex.compile(
    "[^\x00-՗א-תء-يअ-हก-ะḀ-ἕ‐-‧"
    "‰-⁞₠-₿←-⏺─-⭳　-〩ぁ-ゖァ-ヾ"
    "一-鿯가-힣！-～\U0001f300-\U0001f6d5]")


def byte_signs() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in
    Latin-1, else the next unused one from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _for_ascii(pattern: str) -> re.Pattern | None:
    """The pattern with the ASCII members of its classes, for the plain `re` module, which is
    faster; None if it names classes outside of brackets."""
    plain = regex.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
                      .replace(r"\s", r"\t-\r "), pattern)
    return None if regex.search(r"\\(?![tr])", plain) else re.compile(plain)


def cutter(pattern: str, by_library: Callable[[str], list[str]]) -> Callable[[str], list[str]]:
    """Cuts a text at the matches of `pattern`, in which white space, letters and numbers are
    those of the library's Unicode version."""
    any_sign, ascii_only = regex.compile(pattern), _for_ascii(pattern)

    def cut(text: str) -> list[str]:
        if ascii_only and text.isascii():
            return ascii_only.findall(text)
        return by_library(text) if UNSETTLED.search(text) else any_sign.findall(text)

    return cut
