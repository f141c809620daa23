"""String methods of expressions. Positions in substring and slice count from 0, in replace_slice and strpos from 1."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.nulls import literal

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\r\x0b\x0c"


class StringMethods:
    """Reached as expr.str.upper() or expr.upper()."""

    def __init__(self, expr: Any):
        self._expr, self._c = expr, expr.column

    def _s(self, column: Column):
        return self._expr._with(column)

    def _b(self, column: Column):
        return self._expr._bool(column)

    # ---- case

    def upper(self):
        return self._s(F.upper(self._c))

    def lower(self):
        return self._s(F.lower(self._c))

    to_uppercase, to_lowercase = upper, lower

    def swapcase(self):
        """A-Z and a-z by translate; other letters by comparing each with its upper form."""
        swapped = F.transform(F.split(self._c, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x)))
        plain = F.translate(self._c, UPPER + LOWER, LOWER + UPPER)
        return self._s(F.when(F.octet_length(self._c) == F.char_length(self._c), plain).otherwise(F.array_join(swapped, "")))

    def capitalize(self):
        return self._s(F.concat(F.upper(F.substring(self._c, 1, 1)), F.lower(F.substring(self._c, 2, 2**31 - 1))))

    def title(self):
        return self._s(F.initcap(self._c))

    initcap = title

    # ---- trimming and padding

    def trim(self, characters: Any = None):
        return self._s(F.btrim(self._c, literal(WHITE if characters is None else characters)))

    def ltrim(self, characters: Any = None):
        return self._s(F.ltrim(self._c, literal(WHITE if characters is None else characters)))

    def rtrim(self, characters: Any = None):
        return self._s(F.rtrim(self._c, literal(WHITE if characters is None else characters)))

    strip_chars, strip_chars_start, strip_chars_end = trim, ltrim, rtrim

    def strip_prefix(self, prefix: Any):
        p = literal(prefix)
        return self._s(F.when(self._c.startswith(p), F.substring(self._c, F.char_length(p) + 1, F.char_length(self._c))).otherwise(self._c))

    def strip_suffix(self, suffix: Any):
        s = literal(suffix)
        return self._s(F.when(self._c.endswith(s), F.substring(self._c, F.lit(1), F.char_length(self._c) - F.char_length(s))).otherwise(self._c))

    def lpad(self, length: Any, characters: Any = None):
        """Pads only; a longer string stays whole."""
        n = literal(length)
        return self._s(F.when(F.char_length(self._c) >= n, self._c).otherwise(F.lpad(self._c, n, literal(" " if characters is None else characters))))

    def rpad(self, length: Any, characters: Any = None):
        n = literal(length)
        return self._s(F.when(F.char_length(self._c) >= n, self._c).otherwise(F.rpad(self._c, n, literal(" " if characters is None else characters))))

    def center(self, length: Any, character: Any = None):
        """As Python's str.center: of an odd margin the extra character goes left if the width is odd."""
        n, fill = literal(length), literal(" " if character is None else character)
        have = F.char_length(self._c)
        left = F.floor((n - have) / 2) + F.when((n - have) % 2 == 1, n % 2).otherwise(0)
        padded = F.rpad(F.concat(F.repeat(fill, left.cast("int")), self._c), n, fill)
        return self._s(F.when(have >= n, self._c).otherwise(padded))

    # ---- slices

    def substring(self, start: Any, length: Any = None):
        """From a 0-based start; a negative one counts from the end."""
        s = literal(start)
        at = F.when(s < 0, s).otherwise(s + 1)
        return self._s(F.substring(self._c, at, literal(2**31 - 1 if length is None else length)))

    slice = substring

    def left(self, count: Any):
        return self._s(F.left(self._c, literal(count)))

    def right(self, count: Any):
        return self._s(F.right(self._c, literal(count)))

    def replace_slice(self, start: Any, length: Any, replacement: Any):
        return self._s(F.overlay(self._c, literal(replacement), literal(start), literal(length)))

    # ---- lengths

    def char_length(self):
        return self._s(F.char_length(self._c))

    length = len = len_chars = char_length

    def bit_length(self):
        return self._s(F.bit_length(self._c))

    def octet_length(self):
        return self._s(F.octet_length(self._c))

    # ---- search

    def _pair(self, other: Any, case_sensitive: bool) -> tuple[Column, Column]:
        o = literal(other)
        return (self._c, o) if case_sensitive else (F.lower(self._c), F.lower(o))

    def contains(self, substring: Any, case_sensitive: bool = True):
        a, b = self._pair(substring, case_sensitive)
        return self._b(a.contains(b))

    def starts_with(self, prefix: Any, case_sensitive: bool = True):
        a, b = self._pair(prefix, case_sensitive)
        return self._b(a.startswith(b))

    def ends_with(self, suffix: Any, case_sensitive: bool = True):
        a, b = self._pair(suffix, case_sensitive)
        return self._b(a.endswith(b))

    def strpos(self, substring: Any, case_sensitive: bool = True):
        """1-based place, 0 if absent."""
        a, b = self._pair(substring, case_sensitive)
        return self._s(F.instr(a, b))

    def count_substring(self, substring: Any, case_sensitive: bool = True):
        a, b = self._pair(substring, case_sensitive)
        return self._s(F.try_divide(F.char_length(a) - F.char_length(F.replace(a, b, F.lit(""))), F.char_length(b)).cast("long"))

    def like(self, pattern: str, case_sensitive: bool = True):
        return self._b(self._c.like(pattern) if case_sensitive else self._c.ilike(pattern))

    # ---- regular expressions (Java's dialect)

    def _pattern(self, pattern: str, case_sensitive: bool = True, multiline: bool = False, dotall: bool = False) -> str:
        if not isinstance(pattern, str):
            raise TypeError("a pattern is a str")
        flags = ("" if case_sensitive else "i") + ("m" if multiline else "") + ("s" if dotall else "")
        return f"(?{flags}){pattern}" if flags else pattern

    def regex_contains(self, pattern: str, *, case_sensitive: bool = True):
        return self._b(self._c.rlike(self._pattern(pattern, case_sensitive)))

    def regex_match(self, pattern: str, *, case_sensitive: bool = True):
        """Whether the whole string matches."""
        return self._b(self._c.rlike(self._pattern(f"^(?:{pattern})$", case_sensitive)))

    def regexp_match_substring(
        self,
        pattern: str,
        position: int | None = None,
        occurrence: int | None = None,
        group: int | None = None,
        *,
        case_sensitive: bool = True,
        multiline: bool = False,
        dotall: bool = False,
    ):
        """The occurrence-th match from a 1-based position, or a group of it; NULL if there is none."""
        text = F.substring(self._c, position, 2**31 - 1) if position and position > 1 else self._c
        found = F.regexp_extract_all(text, F.lit(self._pattern(pattern, case_sensitive, multiline, dotall)), F.lit(group or 0))
        return self._s(F.try_element_at(found, F.lit(occurrence or 1)))

    def regexp_match_substring_all(self, pattern: str, group: int | None = None, *, case_sensitive: bool = True):
        return self._s(F.regexp_extract_all(self._c, F.lit(self._pattern(pattern, case_sensitive)), F.lit(group or 0)))

    def regexp_strpos(self, pattern: str, *, case_sensitive: bool = True):
        return self._s(F.regexp_instr(self._c, F.lit(self._pattern(pattern, case_sensitive))))

    def regexp_count_substring(self, pattern: str, *, case_sensitive: bool = True):
        return self._s(F.regexp_count(self._c, F.lit(self._pattern(pattern, case_sensitive))))

    def regexp_replace(self, pattern: str, replacement: str, position: int | None = None, occurrence: int | None = None, case_sensitive: bool = True):
        """All matches, or (occurrence 1) the first only."""
        p = self._pattern(pattern, case_sensitive)
        if occurrence in (None, 0):
            return self._s(F.regexp_replace(self._c, p, replacement))
        return self._s(F.regexp_replace(self._c, f"(?s)^(.*?)(?:{p})(.*)$", "$1" + replacement + "$2"))

    regex_replace = regexp_replace

    def regexp_string_split(self, pattern: str, case_sensitive: bool = True):
        return self._s(F.split(self._c, self._pattern(pattern, case_sensitive), -1))

    # ---- composition

    def replace(self, old: Any, new: Any, case_sensitive: bool = True):
        """All occurrences of a literal."""
        if case_sensitive:
            return self._s(F.replace(self._c, literal(old), literal(new)))
        if not isinstance(old, str) or not isinstance(new, str):
            raise TypeError("without case the literals are str")
        return self._s(F.regexp_replace(self._c, "(?i)" + re.escape(old), new.replace("\\", "\\\\").replace("$", "\\$")))

    def string_split(self, separator: str):
        return self._s(F.split(self._c, re.escape(separator), -1))

    def concat(self, *others: Any):
        """NULL if any part is."""
        return self._s(F.concat(self._c, *map(literal, others)))

    def concat_ws(self, separator: str, *others: Any):
        """NULL parts are left out."""
        return self._s(F.concat_ws(separator, self._c, *map(literal, others)))

    def repeat(self, count: Any):
        return self._s(F.repeat(self._c, literal(count)))

    def reverse(self):
        return self._s(F.reverse(self._c))

    # ---- parsing

    def strptime_timestamp(self, format: str):
        from tessera.functions.datetimes import java_pattern

        return self._s(F.try_to_timestamp(self._c, F.lit(java_pattern(format))).cast("timestamp_ntz"))

    def strptime_date(self, format: str):
        from tessera.functions.datetimes import java_pattern

        return self._s(F.try_to_timestamp(self._c, F.lit(java_pattern(format))).cast("date"))

    def strptime_time(self, format: str):
        from tessera.functions.datetimes import java_pattern

        return self._s(F.date_format(F.try_to_timestamp(self._c, F.lit(java_pattern(format))), "HH:mm:ss.SSSSSS"))
