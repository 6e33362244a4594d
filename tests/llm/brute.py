"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def leftmost(pattern: str, text: str, keep=lambda found: True, flags: int = re.ASCII) -> list[tuple[int, int]]:
    return [found.span() for found in re.finditer(pattern, text, flags) if keep(found)]


def luhn(text: str) -> bool:
    digits = [int(char) for char in text if char.isdigit()][::-1]
    doubled = [sum(divmod(2 * digit, 10)) for digit in digits[1::2]]
    return (sum(digits[::2]) + sum(doubled)) % 10 == 0


def n_digits(text: str) -> int:
    return sum(char in "0123456789" for char in text)


def personal_data(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", *span) for span in leftmost(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *span) for span in leftmost(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")))]
    spans += [("card", *span) for span in leftmost(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 14 <= n_digits(m[0]) <= 19 and luhn(m[0]))]
    spans += [("phone", *span) for span in leftmost(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 10 <= n_digits(m[0]) <= 15)]
    return sorted(spans, key=lambda span: (span[1], ("email", "ip", "card", "phone").index(span[0])))


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", *span) for span in leftmost(ASSIGN, text, lambda m: len(m[2]) >= 6, re.ASCII | re.IGNORECASE)]
    spans += [("access", *span) for span in leftmost("AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 20)]
    spans += [("hex", *span) for span in leftmost("[0-9a-f]+", text, lambda m: len(m[0]) >= 24)]
    return sorted(spans, key=lambda span: (span[1], ("assign", "access", "hex").index(span[0])))


def listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingles(text: str | None, width: int = 5) -> frozenset[tuple[bytes, ...]]:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[at : at + width]) for at in range(max(1, len(words) - width + 1)))


def components(texts: dict[int, str | None], width: int = 5) -> dict[int, tuple[int, int]]:
    """Set size and smallest linked id of every document, by comparing all pairs."""
    sets = {key: shingles(text, width) for key, text in texts.items()}
    root = {key: key for key in texts}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(sets)
    for at, one in enumerate(keys):
        for other in keys[at + 1 :]:
            both = len(sets[one] & sets[other])
            if both and 100 * both >= 80 * len(sets[one] | sets[other]):
                a, b = find(one), find(other)
                root[max(a, b)] = min(a, b)
    return {key: (len(sets[key]), find(key)) for key in keys}
