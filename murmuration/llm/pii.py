"""Format-preserving pseudonyms for personal data, in SQL expressions alone.

A found number or date is validated, mapped to whole numbers (a, b) with 0 <= a < m and 0 <= b < n that cover just the
valid values of its format, permuted there by a keyed Feistel network of eight rounds, and written back in its format.
Equal values get equal pseudonyms in all documents, different ones stay different, and the key holder can reverse it.
Mail names and secrets have no such domain; they become keyed digests of the same kind of characters, linked likewise
but not reversible.

    kind    found                                   kept                        permuted
    card    13 to 19 digits, also in fours, with    length, separators, first   the rest; the check digit stays valid
            a valid check digit                     two digits
    phone   +1 (ddd) ddd-dddd and other + numbers   separators, country digit   area, exchange, line (each stays valid)
    ssn     ddd-dd-dddd with valid parts            separators                  all three parts (each stays valid)
    ip      four numbers of 0 to 255                dots                        all 32 bits
    date    yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy      format                      the day within its cycle of 400 years
    iban    valid check digits                      country, letters, blanks    digits; check digits stay valid
    email   name@domain                             domain                      name (digest)
    secret  access keys, key=value, hex digests     length and character kinds  all (digest)

Names of keys count in any case, with blanks and quotes round the sign of equality, which are kept; hex digests are in
small letters or in capitals.

What fails validation (999.1.1.1, 2023-02-30, a wrong IBAN, an order number of 16 digits) is no such number and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Formats in Java's syntax; kinds in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_key)[\"']?[ \t]*=[ \t]*(?:\"[^\"\r\n]{6,}\"|'[^'\r\n]{6,}'|[\"']?[^\s\"']{6,})|(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+-])(?:\+?1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])|\+[0-9](?:[ ()-]{0,2}[0-9]){7,14}(?!-?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4}(?![0-9/])",
    "card": r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9-])",
}
#: A text without a digit or @ has none of these but keys and digests of letters only.
HINT = r"[0-9@]|AKIA|=[ \t]*\S|[a-f]{32}|[A-F]{32}"
ROUNDS = 8


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with name standing for value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _feistel(a: str, b: str, m: str, n: str, kind: str, key: str, back: bool) -> str:
    """struct<a, b>: the keyed permutation of (a, b) in [0, m) x [0, n)."""

    def step(x: str, y: str, mod: str) -> str:
        f = f"CAST(conv(substr(sha2(concat_ws('|', {key}, {_q(kind)}, {m}, {n}, i, {y}), 256), 1, 14), 16, 10) AS BIGINT)"
        return f"pmod({x} {'-' if back else '+'} {f} % {mod}, {mod})"

    order = f"sequence({ROUNDS - 1}, 0, -1)" if back else f"sequence(0, {ROUNDS - 1})"
    start = f"named_struct('a', CAST({a} AS BIGINT), 'b', CAST({b} AS BIGINT))"
    one = f"named_struct('a', CAST({step('s.a', 's.b', m)} AS BIGINT), 'b', s.b)"
    other = f"named_struct('a', s.a, 'b', CAST({step('s.b', 's.a', n)} AS BIGINT))"
    return f"aggregate({order}, {start}, (s, i) -> IF(i % 2 = 0, {one}, {other}))"


def _digits(d: str, kind: str, key: str, back: bool) -> str:
    """d, a string of two or more digits, permuted among those of its length."""
    m, n = f"CAST(pow(10, length({d}) DIV 2) AS BIGINT)", f"CAST(pow(10, length({d}) - length({d}) DIV 2) AS BIGINT)"
    f = _feistel(f"substr({d}, 1, length({d}) DIV 2)", f"substr({d}, length({d}) DIV 2 + 1)", m, n, kind, key, back)
    return _let("f", f, f"concat(lpad(f.a, length({d}) DIV 2, '0'), lpad(f.b, length({d}) - length({d}) DIV 2, '0'))")


def _refill(text: str, digits: str) -> str:
    """text with its digits replaced by the given ones, in order."""
    step = "IF(c >= '0' AND c <= '9', named_struct('o', concat(t.o, substr(t.d, t.k, 1)), 'd', t.d, 'k', t.k + 1), named_struct('o', concat(t.o, c), 'd', t.d, 'k', t.k))"
    return f"aggregate(split({text}, ''), named_struct('o', '', 'd', {digits}, 'k', 1), (t, c) -> {step}, t -> t.o)"


def _luhn(payload: str) -> str:
    """Check digit of a string of digits."""
    x = f"CAST(substr({payload}, -j, 1) AS INT) * (1 + j % 2)"
    return f"(10 - aggregate(sequence(1, length({payload})), 0L, (u, j) -> u + ({x}) DIV 10 + ({x}) % 10) % 10) % 10"


def _mod97(code: str) -> str:
    value = "IF(c >= 'A', CAST(ascii(c) - 55 AS STRING), c)"
    return f"aggregate(split(concat(substr({code}, 5), substr({code}, 1, 4)), ''), 0L, (u, c) -> CAST(concat(CAST(u AS STRING), {value}) AS BIGINT) % 97)"


def _digest_like(text: str, kind: str, key: str) -> str:
    """Characters of the kinds in text, from a keyed digest of it: hex of hex in its case, else digits, letters by case."""
    stream = f"sha2(concat_ws('|', {key}, {_q(kind)}, {text}), 512)"
    byte = "CAST(conv(substr(t.h, t.k % 120 + 1, 4), 16, 10) AS INT)"
    pick = f"""CASE WHEN t.x THEN substr(t.h, t.k % 128 + 1, 1) WHEN t.u THEN upper(substr(t.h, t.k % 128 + 1, 1))
      WHEN c >= '0' AND c <= '9' THEN CAST({byte} % 10 AS STRING) WHEN c >= 'a' AND c <= 'z' THEN char(97 + {byte} % 26)
      WHEN c >= 'A' AND c <= 'Z' THEN char(65 + {byte} % 26) ELSE c END"""
    start = f"named_struct('o', '', 'h', {stream}, 'k', 0, 'x', {text} rlike '^[0-9a-f]+$', 'u', {text} rlike '^[0-9A-F]+$')"
    step = f"named_struct('o', concat(t.o, {pick}), 'h', t.h, 'k', t.k + 1, 'x', t.x, 'u', t.u)"
    return f"aggregate(split({text}, ''), {start}, (t, c) -> {step}, t -> t.o)"


def _date(kind: str, key: str, back: bool) -> str:
    # 400 years have 146,097 = 189 x 773 days in any calendar cycle; the cycle of a date is kept.
    form = "IF(x rlike '^[0-9]{4}-', 'yyyy-MM-dd', IF(x like '%.%', 'dd.MM.yyyy', 'MM/dd/yyyy'))"
    day = "datediff(d, DATE'2000-01-01')"
    moved = _let("f", _feistel(f"pmod({day}, 146097) DIV 773", f"pmod({day}, 146097) % 773", "189", "773", kind, key, back), f"date_format(date_add(DATE'2000-01-01', CAST({day} - pmod({day}, 146097) + f.a * 773 + f.b AS INT)), {form})")
    return _let("d", f"CAST(try_to_timestamp(x, {form}) AS DATE)", f"IF(d IS NULL OR year(d) < 1, x, {moved})")


def _pseudonym(key: str, back: bool) -> str:
    """SQL expression for the pseudonym of x, struct<kind, value>; kind is null if x is not valid."""
    digits = "regexp_replace(x, '[^0-9]', '')"
    rest = _digits("substr(d, 3, length(d) - 3)", "card", key, back)
    card = _let("d", digits, f"IF(CAST(right(d, 1) AS INT) = {_luhn('left(d, length(d) - 1)')}, {_refill('x', _let('p', f'concat(left(d, 2), {rest})', f'concat(p, {_luhn("p")})'))}, x)")
    # North American numbers: area and exchange 200 to 999 each, line of four digits.
    f = _feistel("(CAST(left(n, 3) AS INT) - 200) * 800 + CAST(substr(n, 4, 3) AS INT) - 200", "right(n, 4)", "640000", "10000", "phone", key, back)
    nanp = _let("f", f, "concat(200 + f.a DIV 800, 200 + f.a % 800, lpad(f.b, 4, '0'))")
    is_nanp = "d rlike '^1?[2-9][0-9]{2}[2-9][0-9]{6}$'"
    phone = _let("d", digits, f"IF({is_nanp}, {_refill('x', _let('n', 'right(d, 10)', f'concat(left(d, length(d) - 10), {nanp})'))}, {_refill('x', f'concat(left(d, 1), {_digits("substr(d, 2)", "number", key, back)})')})")
    # Social security: area 1 to 899 without 666, group 1 to 99, serial 1 to 9999.
    area = "CAST(left(x, 3) AS INT)"
    f = _feistel(f"({area} - 1 - IF({area} > 666, 1, 0)) * 99 + CAST(substr(x, 5, 2) AS INT) - 1", "CAST(right(x, 4) AS INT) - 1", str(898 * 99), "9999", "ssn", key, back)
    ssn = _let("f", f, _let("r", "f.a DIV 99 + 1", "concat(lpad(r + IF(r >= 666, 1, 0), 3, '0'), '-', lpad(f.a % 99 + 1, 2, '0'), '-', lpad(f.b + 1, 4, '0'))"))
    ssn = f"IF(x rlike '^(000|666|9)|-00-|-0000$', x, {ssn})"
    f = _feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", "ip", key, back)
    ip = _let("o", "transform(split(x, '[.]'), v -> CAST(v AS INT))", f"IF(array_max(o) > 255, x, {_let('f', f, "concat_ws('.', f.a DIV 256, f.a % 256, f.b DIV 256, f.b % 256)")})")
    # The first two digits of an IBAN are its check digits, computed over the rest.
    own = _refill("substr(c, 5)", _digits("regexp_replace(substr(c, 5), '[^0-9]', '')", "iban", key, back))
    fresh = _let("p", own, f"concat(left(c, 2), lpad(98 - {_mod97("concat(left(c, 2), '00', p)")}, 2, '0'), p)")
    spaced = "aggregate(split(x, ''), named_struct('o', '', 'd', q, 'k', 1), (t, c) -> IF(c = ' ', named_struct('o', concat(t.o, c), 'd', t.d, 'k', t.k), named_struct('o', concat(t.o, substr(t.d, t.k, 1)), 'd', t.d, 'k', t.k + 1)), t -> t.o)"
    iban = _let("c", "replace(x, ' ', '')", f"IF({_mod97('c')} <> 1 OR length(regexp_replace(substr(c, 5), '[^0-9]', '')) < 2, x, {_let('q', fresh, spaced)})")
    email = f"concat({_digest_like('lower(substring_index(x, chr(64), 1))', 'email', key)}, '@', substring_index(x, chr(64), -1))"
    # Of name = "value" all but the value stays.
    named = _q("^([^=]*=[ \\t]*[\"']?)(.*?)([\"']?)$")
    value = f"regexp_extract(x, {named}, 2)"
    secret = f"IF(x like '%=%', concat(regexp_extract(x, {named}, 1), {_digest_like(value, 'secret', key)}, regexp_extract(x, {named}, 3)), IF(x rlike '^AKIA[0-9A-Z]{{16}}$', concat('AKIA', {_digest_like('substr(x, 5)', 'secret', key)}), {_digest_like('x', 'secret', key)}))"
    made = {"email": "x" if back else email, "secret": "x" if back else secret, "iban": iban, "ip": ip, "phone": phone, "ssn": ssn, "date": _date("date", key, back), "card": card}
    cases = " ".join(f"WHEN x rlike {_q('^(?:' + PATTERNS[k] + ')$')} THEN named_struct('kind', {_q(k)}, 'value', {v})" for k, v in made.items())
    return f"CASE {cases} ELSE named_struct('kind', '', 'value', x) END"


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", reverse: bool = False, found_col: str = "pii") -> DataFrame:
    """Replace personal data in a text column by pseudonyms under a secret key; add found_col, a sorted array of the kinds replaced.

    Every row stays, with its other columns; a column named found_col is replaced. Null stays null (found_col is then
    empty), and a text without personal data stays as it is. Texts are searched whole. With reverse, numbers and dates
    in a pseudonymized text become what they were (same key); mail names and secrets stay. Numbers of 8 to 15 digits after a
    plus sign are permuted without a look at their country code.
    """
    pattern = _q("|".join(f"(?:{p})" for p in PATTERNS.values()))
    text = f"`{text_col}`"
    some = f"coalesce({text} rlike {_q(HINT)}, false)"
    h, n, k = unused(df, "_hits"), unused(df, "_new"), unused(df, "_key")
    # The key comes from a table of one row, so that plans, the UI and event logs don't show it.
    secret = df.sparkSession.createDataFrame([(key,)], "k string").scalar()
    hits = F.expr(f"IF({some}, regexp_extract_all({text}, {pattern}, 0), CAST(array() AS array<string>))")
    out = df.withColumn(h, hits).withColumn(k, secret).withColumn(n, F.expr(f"transform({h}, x -> {_pseudonym(f'`{k}`', reverse)})"))
    joined = F.expr(f"IF(size({h}) = 0, {text}, array_join(zip_with(split({text}, {pattern}, -1), {n}, (p, v) -> concat(p, coalesce(v.value, ''))), ''))")
    kinds = F.expr(f"array_sort(transform(filter(zip_with({h}, {n}, (w, v) -> named_struct('k', v.kind, 'c', w <> v.value)), z -> z.c), z -> z.k))")
    return out.withColumns({text_col: joined, found_col: kinds}).drop(h, n, k)
