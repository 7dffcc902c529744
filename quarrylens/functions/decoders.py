"""Decoders as Column expressions. Whatever cannot be decoded is null."""

from __future__ import annotations

import base64 as b64
import binascii
import html as markup
import json
import zlib as deflate
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL_SAFE = str.maketrans("+/", "-_")
_TURNED = "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"


def _text(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def base64(s: Column) -> Column:
    """Standard and URL-safe alphabets, with or without padding; white space is dropped."""
    s = F.translate(F.regexp_replace(s, r"[\s=]+", ""), "-_", "+/")
    return F.when(s.rlike("^[A-Za-z0-9+/]+$"), _text(F.try_to_binary(F.rpad(s, F.length(s) + F.pmod(-F.length(s), F.lit(4)), "="), F.lit("base64"))))


def hex_text(s: Column) -> Column:
    """Hexadecimal pairs; white space, colons and dashes between them are dropped."""
    s = F.regexp_replace(s, r"[\s:\-]+", "")
    return F.when(s.rlike("^(?:[0-9a-fA-F]{2})+$"), _text(F.unhex(s)))


def url_text(s: Column) -> Column:
    """Percent and plus notation; null if there is none of either."""
    return F.when(s.rlike("[%+]"), F.try_url_decode(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25")))


def rot13(s: Column) -> Column:
    return F.when(s.rlike("[A-Za-z]"), F.translate(s, _ALPHABET, _TURNED))


def _each(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A decoder that SQL functions cannot express, over Arrow batches."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return f(text) if text else None
            except (binascii.Error, ValueError, deflate.error):
                return None

        return texts.map(one)

    return run


def _base32(text: str) -> str:
    text = "".join(text.split()).upper().rstrip("=")
    return b64.b32decode(text + "=" * (-len(text) % 8)).decode(errors="replace")


def _entities(text: str) -> str | None:
    return out if (out := markup.unescape(text)) != text else None


def _readings(text: str) -> Iterator[bytes]:
    """Bytes that a text may stand for: base64 of either alphabet, hexadecimal, its characters as Latin-1."""
    plain = "".join(text.split())
    for read in (lambda: b64.urlsafe_b64decode(plain.translate(_URL_SAFE) + "=" * (-len(plain) % 4)), lambda: bytes.fromhex(plain)):
        try:
            yield read()
        except (binascii.Error, ValueError):
            continue
    yield text.encode("latin-1", errors="replace")


def _inflate(window: int, most: int = 0) -> Callable[[str], str | None]:
    """Compressed bytes as text, by the first reading that can be inflated. With ``most``, longer outputs are null; none is cut."""

    def f(text: str) -> str | None:
        for raw in _readings(text):
            stream = deflate.decompressobj(window)
            try:
                out = stream.decompress(raw, most)
            except deflate.error:
                continue
            return None if most and stream.unconsumed_tail else out.decode(errors="replace") if stream.eof else None
        return None

    return f


def _jwt(text: str) -> str | None:
    """Header and payload of a token as indented JSON; the signature is not verified."""
    parts = text.strip().split(".")
    if len(parts) != 3:
        return None
    read = lambda x: json.loads(b64.urlsafe_b64decode(x + "=" * (-len(x) % 4)))
    return json.dumps({"header": read(parts[0]), "payload": read(parts[1])}, indent=2)


def gunzip(most: int = 0) -> Callable[[Column], Column]:
    return _each(_inflate(31, most))


def inflate(most: int = 0) -> Callable[[Column], Column]:
    return _each(_inflate(15, most))


base32, html, gzip, zlib, jwt = _each(_base32), _each(_entities), gunzip(), inflate(), _each(_jwt)

DECODERS: dict[str, Callable[[Column], Column]] = {"base32": base32, "base64": base64, "gzip": gzip, "hex": hex_text, "html": html, "jwt": jwt, "rot13": rot13, "url": url_text, "zlib": zlib}


def decode(operation: str, s: Column) -> Column:
    if operation not in DECODERS:
        raise ValueError(f"unknown decoder {operation!r}; there are {', '.join(sorted(DECODERS))}")
    return DECODERS[operation](s)


def register(spark) -> None:
    """Make the text functions callable from SQL as temporary functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rot13(s STRING) RETURNS STRING RETURN " + f"translate(s, '{_ALPHABET}', '{_TURNED}')")
