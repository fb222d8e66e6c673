"""Format-preserving Feistel pseudonyms for personal numbers, dates and mail addresses, in SQL functions only.

A value is validated (Luhn number, calendar date, address octets, areas of numbers), and a keyed permutation of the
valid values of its format takes it to another one: digits stay digits, separators stay in place, a valid check digit
stays valid, a date stays a date. The permutation depends on key and format alone, so equal values get equal pseudonyms in all
documents, and different ones stay different.

Kinds, in the order in which they are tried:

* mail addresses: letters and digits of the part before the @, in pieces of 12 letters a-z, 18 digits and 16 letters beyond
  a-z (which become any such letters); the domain stays;
* international phone numbers: all but the country code;
* hexadecimal keys of 32 to 64 digits in quotes, in pieces of 16;
* IPv4 addresses, but for those of networks 0 and 127 and for version numbers (after "version", "release" or "build");
* dates from 1800 to 2199 as yyyy-mm-dd, dd/mm/yyyy and dd.mm.yyyy;
* ddd-dd-dddd numbers with an area of 001 to 899 but 666, a group from 01 and a serial from 0001;
* numbers of 13 to 19 digits that pass Luhn's check, alone or beside a short number.

Defined cases: a null text stays null and an empty one empty; a text without values stays as it is, byte for byte;
what looks like a value but fails validation (octet of 300, 30 February, wrong check digit) stays; values of any length take
time in proportion to it (times its logarithm); very long texts are one row and one scan; repeated rows and all other
columns are kept, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DATE = {
    "yyyy-MM-dd": r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])",
    "dd/MM/yyyy": r"(?:0[1-9]|[12][0-9]|3[01])/(?:0[1-9]|1[0-2])/[0-9]{4}",
    "dd.MM.yyyy": r"(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.[0-9]{4}",
}
# Repeated groups are possessive: the regex engine runs them in a loop, without a frame on its stack for each turn.
_MAIL = r"[\p{L}0-9][\p{L}0-9._%+-]*+@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)++"
_PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_VERSION = r"(?<!(?:[Vv]ersion|[Rr]elease|[Bb]uild)[ :]{1,2})"
_LONG = r"[0-9](?:[ -]?[0-9]){12,18}"
_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_HEX = r'(?<=")[0-9A-Fa-f]{32,64}(?=")'
# One pass finds them all. Letters and digits before or after a number make it something else.
_BEFORE, _AFTER = r"(?<![\p{L}0-9._%+-])", r"(?![\p{L}0-9]|[.-][0-9])"
PATTERN = rf"(?<![\p{{L}}0-9._%+-]){_MAIL}|(?<![\p{{L}}0-9]){_PHONE}(?![0-9])|{_HEX}|{_BEFORE}(?:{_VERSION}{_IP}|{'|'.join(_DATE.values())}|{_SSN}|{_LONG}){_AFTER}"

# Values that are one number: a code in the place of a radix, and the sizes of both halves.
DAY, QUAD, AREA = 0, 1, 2
SIZES = {DAY: (189, 773), QUAD: (254 * 256, 256 * 256), AREA: (898 * 99, 9999)}
NET = 1 << 24


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with a name for a value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hash(key: str, *parts: str) -> str:
    """SQL for 60 bits of a keyed hash."""
    return f"cast(conv(substr(sha2(concat_ws('|', {', '.join((key, *parts))}), 256), 1, 15), 16, 10) as bigint)"


def _permute(x: str, key: str) -> str:
    """SQL for the permuted characters of a struct (t: tweak, d: up to 19 digits, radix); key: SQL for the key.

    A number of radix r and n digits is a pair in Z_a x Z_b with a = r^floor(n/2) and b = r^ceil(n/2); each round adds a keyed
    hash of one half to the other. The codes of ``SIZES`` stand for plain numbers, as pairs of these sizes.
    """
    n, plain = f"length({x}.d)", f"{x}.radix <= {AREA}"
    u, v = f"cast(floor({n} / 2) as int)", f"cast(ceil({n} / 2) as int)"
    size = lambda i: f"case {x}.radix {' '.join(f'when {c} then {s[i]}L' for c, s in SIZES.items())} else cast(pow({x}.radix, {(u, v)[i]}) as bigint) end"
    half = lambda part: f"cast(conv(concat('0', {part}), {x}.radix, 10) as bigint)"
    start = (
        f"named_struct('l', if({plain}, cast({x}.d as bigint) div z.b, {half(f'substr({x}.d, 1, {u})')}),"
        f" 'r', if({plain}, cast({x}.d as bigint) % z.b, {half(f'substr({x}.d, {u} + 1)')}), 'a', z.a, 'b', z.b)"
    )
    start = _let(f"named_struct('a', {size(0)}, 'b', {size(1)})", "z", start)
    hashed = _hash(key, f"{x}.t", f"if({plain}, '', cast({n} as string))", "cast(i as string)", "cast(if(i % 2 = 0, s.r, s.l) as string)")
    step = "named_struct('l', if(i % 2 = 0, pmod(s.l + h, s.a), s.l), 'r', if(i % 2 = 0, s.r, pmod(s.r + h, s.b)), 'a', s.a, 'b', s.b)"
    rounds = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> {_let(hashed, 'h', step)})"
    shown = lambda y, k: f"lpad(lower(conv(cast({y} as string), 10, {x}.radix)), {k}, '0')"
    return _let(rounds, "p", f"if({plain}, cast(p.l * p.b + p.r as string), concat({shown('p.l', u)}, {shown('p.r', v)}))")


def _luhn(d: str) -> str:
    """SQL for Luhn's sum of digits, modulo 10; 0 if the last one is right."""
    digit = f"cast(substr({d}, length({d}) - j, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, j) -> t + {_let(digit, 'c', 'if(j % 2 = 0, c, if(c > 4, 2 * c - 9, 2 * c))')}) % 10"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _pieces(x: str, n: int) -> str:
    """SQL for the pieces of n characters of a text, in order; none of an empty one."""
    return f"regexp_extract_all({x}, '(?s).{{1,{n}}}', 0)"


def _permute_letters(q: str, t: str, key: str) -> str:
    """SQL for the permuted letters of a piece of letters beyond a-z: twice over it, from both ends, each by what stands before it.

    A letter's code is a pair in Z_512 x Z_512, permuted by keyed rounds until it is a small letter again.
    """
    letter = "decode(unhex(lpad(hex(if(x between 55296 and 57343, 0, x)), 8, '0')), 'UTF-32')"
    ok = f"x > 127 and {_let(letter, 'y', f"y rlike {_text(r'^\p{L}$')} and lower(y) = y")}"
    hashed = _hash(key, "'letter'", t, "pass", f"length({q})", "p", "i", "if(i % 2 = 0, s.r, s.l)")
    step = "named_struct('l', if(i % 2 = 0, pmod(s.l + h, 512L), s.l), 'r', if(i % 2 = 0, s.r, pmod(s.r + h, 512L)))"
    once = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', v.x div 512, 'r', v.x % 512), (s, i) -> {_let(hashed, 'h', step)}, s -> s.l * 512 + s.r)"
    # About half of all codes are no letters; 128 misses in a row don't happen.
    walk = f"aggregate(sequence(0, 127), named_struct('x', cast(ascii(c) as bigint), 'ok', false), (v, w) -> if(v.ok, v, {_let(once, 'x', f"named_struct('x', x, 'ok', {ok})")}), v -> {_let('v.x', 'x', letter)})"
    line = f"aggregate({_pieces('r', 1)}, '', (p, c) -> concat(p, {walk}))"
    return f"aggregate(array('1', '2'), {q}, (r, pass) -> reverse({line}))"


_AZ, _26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _chunk(t: str, d: str, radix: int) -> str:
    return f"named_struct('t', {t}, 'd', {d}, 'radix', {radix})"


def _chunks(t: str, x: str, n: int, radix: int) -> str:
    """SQL for the pieces of a text, each with its number in its tweak."""
    return f"transform({_pieces(x, n)}, (y, z) -> {_chunk(f'concat({t}, z)', 'y', radix)})"


def _filled(parts: dict[str, str]) -> str:
    """SQL for w with its characters of each class replaced, in order, by those of a text: {class: SQL of the text}."""
    of = f"case when c rlike '[0-9]' then 'n' when k <> 'mail' then '' when c rlike '[a-z]' then 'a' when c rlike {_text(r'\p{L}')} then 'u' else '' end"
    put = lambda s, x: f"zip_with(filter(items, e -> e.s = '{s}'), {_pieces(x, 1)}, (e, y) -> named_struct('i', e.i, 'c', y))"
    rest = "transform(filter(items, e -> e.s = ''), e -> named_struct('i', e.i, 'c', e.c))"
    body = f"array_join(transform(array_sort(concat({', '.join(put(s, x) for s, x in parts.items())}, {rest})), e -> e.c), '')"
    return _let(f"transform({_pieces('w', 1)}, (c, i) -> named_struct('i', i, 'c', c, 's', {of}))", "items", body)


def _pseudonym(m: str, key: str) -> str:
    """SQL for the pseudonym of a match: its kind, the pieces of it that are permuted, all by one expression, and the whole again.

    k: kind; w: the text whose shape stays; q: its letters a-z as digits of base 26; g: its decimal digits; v: its number, if
    it is one; o: permuted pieces.
    """
    whole = lambda p: _text(f"^(?:{p})$")
    dates = " ".join(f"when {m} rlike {whole(p)} then {_text(shape)}" for shape, p in _DATE.items())
    kind = (
        f"case when instr({m}, '@') > 0 then 'mail' when {m} rlike '^[+]' then 'phone' when {m} rlike {whole(_IP)} then 'ip' {dates}"
        f" when {m} rlike {whole(_SSN)} then 'ssn' when {m} rlike '^[0-9 -]+$' and length({_digits(m)}) < 20 then 'card' else 'hex' end"
    )
    # Of a number that fails, a card in it: digits in a row, or four times four.
    cards = f"filter(regexp_extract_all({m}, {_text(_CARD)}, 0), x -> {_let(_digits('x'), 'y', _luhn('y') + ' = 0')})"
    card = f"if({_let(_digits(m), 'y', _luhn('y') + ' = 0')}, {m}, get({cards}, 0))"
    # Plain numbers; null if the value is none.
    quad = _let("aggregate(split(w, '[.]'), 0L, (t, y) -> t * 256 + cast(y as bigint))", "x", f"if(x div {NET} in (0, 127), null, x - if(x div {NET} < 127, {NET}, 2 * {NET}))")
    area = _let("transform(split(w, '-'), y -> cast(y as bigint))", "x", "if(x[0] in (0, 666) or x[0] > 899 or x[1] = 0 or x[2] = 0, null, ((x[0] - if(x[0] < 666, 1, 2)) * 99 + x[1] - 1) * 9999 + x[2] - 1)")
    day = _let("datediff(cast(try_to_timestamp(w, k) as date), date'1800-01-01')", "x", "if(x between 0 and 146096, cast(x as bigint), null)")
    number = f"cast(case when k in ('mail', 'phone', 'card', 'hex') then null when k = 'ip' then {quad} when k = 'ssn' then {area} else {day} end as string)"
    chunks = (
        f"case k when 'mail' then concat({_chunks(_text('letters'), 'q', 12, 26)}, {_chunks(_text('mail'), 'g', 18, 10)}) when 'phone' then array({_chunk('k', 'right(g, 10)', 10)})"
        f" when 'card' then array({_chunk(_text('luhn'), 'left(g, length(g) - 1)', 10)}) when 'hex' then {_chunks(_text('hex'), 'lower(w)', 16, 16)}"
        f" when 'ip' then array({_chunk('k', 'v', QUAD)}) when 'ssn' then array({_chunk('k', 'v', AREA)}) else array({_chunk(_text('date'), 'v', DAY)}) end"
    )
    count = "cast(ceil(length(q) / 12) as int)"
    letters = f"translate(array_join(slice(o, 1, {count}), ''), '{_26}', '{_AZ}')"
    beyond = f"regexp_replace(w, {_text(r'[a-z]|[^\p{L}]')}, '')"
    beyond = f"array_join(transform({_pieces(beyond, 16)}, (q, z) -> {_permute_letters('q', 'z', key)}), '')"
    # A card's last digit is as far from the right check digit as it was: valid numbers stay valid.
    last = _let("concat(o[0], '0')", "y", f"cast(pmod(10 - {_luhn('y')}, 10) as string)")
    digits = f"case k when 'mail' then array_join(slice(o, {count} + 1, size(o)), '') when 'phone' then concat(left(g, length(g) - 10), o[0]) else concat(o[0], {last}) end"
    filled = _filled({"n": digits, "a": f"if(k = 'mail', {letters}, '')", "u": f"if(k = 'mail', {beyond}, '')"})
    tail = f"case k when 'mail' then substr({m}, length(substring_index({m}, '@', 1)) + 1) when 'card' then substr({m}, instr({m}, w) + length(w)) else '' end"
    back = (
        f"case k when 'ip' then {_let(f'x + if(x div {NET} < 126, {NET}, 2 * {NET})', 'y', f"concat_ws('.', transform(sequence(3, 0), e -> shiftright(y, 8 * e) & 255))")}"
        " when 'ssn' then printf('%03d-%02d-%04d', x div 9999 div 99 + if(x div 9999 div 99 < 665, 1, 2), x div 9999 % 99 + 1, x % 9999 + 1)"
        " else date_format(date_add(date'1800-01-01', cast(x as int)), k) end"
    )
    body = (
        f"case when k in ('mail', 'phone', 'card') then concat(if(k = 'card', left({m}, instr({m}, w) - 1), ''), {filled}, {tail})"
        f" when k = 'hex' then if(w = upper(w), upper(array_join(o, '')), array_join(o, '')) else {_let('cast(o[0] as bigint)', 'x', back)} end"
    )
    body = _let(f"transform({chunks}, y -> {_permute('y', key)})", "o", body)
    # What isn't valid stays: no number, or no card.
    body = _let(number, "v", f"if(w is null or v is null and k not in ('mail', 'phone', 'card', 'hex'), {m}, {body})")
    body = _let(_digits("w"), "g", body)
    body = _let(f"if(k = 'mail', translate(regexp_replace(w, '[^a-z]', ''), '{_AZ}', '{_26}'), '')", "q", body)
    body = _let(f"case k when 'mail' then lower(substring_index({m}, '@', 1)) when 'card' then {card} else {m} end", "w", body)
    return _let(kind, "k", body)


def pseudonymise(docs: DataFrame, key: str | Column, column: str = "text") -> DataFrame:
    """docs with its values replaced; other columns and the order of columns stay.

    A key given as a text stands in the plan, and so in logs and the UI; a secret one should be a column, such as the
    ``scalar()`` of a table of one row.
    """
    name = f"key_{uuid.uuid4().hex[:12]}"
    text = f"`{column}`"
    found = f"regexp_extract_all({text}, {_text(PATTERN)}, 0)"
    parts = f"split({text}, {_text(PATTERN)}, -1)"
    done = f"transform({found}, m -> {_pseudonym('m', name)})"
    whole = f"array_join(zip_with({parts}, {done}, (a, b) -> concat(a, coalesce(b, ''))), '')"
    # Every value holds a digit, an @, or is a key of letters alone; most texts have none of them and cost one look.
    keyed = docs.withColumn(name, F.lit(key) if isinstance(key, str) else key)
    return keyed.withColumn(column, F.expr(f"case when {text} rlike {_text(r'[0-9@]|"[A-Fa-f]{32}')} then {whole} else {text} end")).drop(name)


def secret(docs: DataFrame, key: str) -> Column:
    """A key as a scalar subquery over a table of one row, whose value no plan shows."""
    return docs.sparkSession.createDataFrame([(key,)], "key string").scalar()


def length_of(text: str, old: str):
    """The length of a changed text in characters; null where the text is null."""
    return F.coalesce(F.length(text).cast("long"), F.col(old).cast("long"))
