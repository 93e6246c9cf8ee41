"""Exact comparison of JSON values, whatever their layout, escapes, key order or number spelling."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal


class Number(str):
    """A JSON number in canonical spelling; the leading NUL keeps it apart from strings in a dump."""

    __slots__ = ()


def number(text: str) -> Number:
    """1, 1.0 and 10e-1 are one number; so are 0 and -0."""
    if "." not in text and "e" not in text and "E" not in text:
        return Number("\0" + ("0" if text == "-0" else text))
    sign, digits, exponent = Decimal(text).as_tuple()
    plain = "".join(map(str, digits)).rstrip("0")
    exponent += len(digits) - len(plain)
    plain = plain.lstrip("0")
    if not plain:
        return Number("\x000")
    if 0 <= exponent < 400:
        plain, exponent = plain + "0" * exponent, 0
    return Number(f"\0{'-' * sign}{plain}" + (f"e{exponent}" if exponent else ""))


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_decode = json.JSONDecoder(parse_int=number, parse_float=number, parse_constant=_no_constant).decode
_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode


def parse(text: str | None):
    """The value of a JSON text; raises ValueError if it is none. The last of equal keys counts."""
    if text is None:
        raise ValueError("null is no JSON text")
    try:
        return _decode(text)
    except RecursionError as error:
        raise ValueError("nested too deeply") from error


def parse_object(text: str | None) -> dict | None:
    """The JSON object that `text` spells, or None."""
    try:
        value = parse(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def canonical(value) -> str:
    """One ASCII text per JSON value."""
    return _encode(value)


def digest(value) -> bytes:
    """16 bytes that stand for a JSON value."""
    return hashlib.blake2b(_encode(value).encode("ascii"), digest_size=16).digest()


def kind(value) -> str:
    """JSON type: null, boolean, number, string, array or object."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Number):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"
