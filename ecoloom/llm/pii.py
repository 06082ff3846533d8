"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Card numbers (Luhn), bank accounts (IBAN, modulo 97), social security numbers, dates, IPv4 and IPv6
addresses, telephone numbers, e-mail addresses, hexadecimal secrets and cloud access keys are found by
pattern, validated, and permuted within their own format by a keyed Feistel network, so equal values get
equal pseudonyms in all documents and the pseudonym is again a valid value of its kind. A domain of a * b
values is a pair (l, r) with l < a and r < b; rounds in turn add a keyed SHA-256 of r to l modulo a and of
l to r modulo b, which is a permutation for any a and b, without cycle walking.

A text is searched once: one replacement puts every match between marks, with its kind in the number of
separators before it, and the rest works on the pieces.

What stays: punctuation and spacing, letter case (upper if the match has no lower-case letter), the
first digit and the validity of the check digit of cards, country and letters of bank accounts, the prefix
of access keys, the first digit of numbers that start with +, the domain of e-mail addresses. Dates are
days from 1900 to 2099 and stay so; a day or month of one digit stays unpadded; x/y/year is month first
where that is a date, else day first. Matches that fail validation stay as they are.

Defined results: a null text stays null, an empty one empty, both with 0 replaced. Other columns and
rows, repeated ones too, are not touched; columns that have the names of the two new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecoloom.llm.common import fresh, let

ROUNDS = 8
SPANS = "array<struct<kind:string,start:int,length:int,pseudonym:string>>"
#: 1900-01-01 to 2099-12-31 are 17 * 4297 days.
FIRST_DAY, DATE_SIDES = "1900-01-01", (17, 4297)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kind -> pattern, in order of precedence: kinds that start where no address character, no letter or digit, or
#: no digit is before them.
ADDRESSES = {"email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"}
CODES = {
    "secret": r"[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ipv6": rf"(?<!:)(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
}
NUMBERS = {
    "iso_date": r"(?<!-)(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}(?![0-9-])",
    "dot_date": r"(?<!\.)[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2}(?![0-9]|\.[0-9])",
    "slash_date": r"(?<!/)[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}(?![0-9/])",
    "ssn": r"(?<!-)(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?<!\+)\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9])",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
}
KINDS = [*ADDRESSES, *CODES, *NUMBERS]
_groups = lambda patterns: "|".join(f"({p})" for p in patterns.values())
ANY = rf"(?<![A-Za-z0-9._%+-]){_groups(ADDRESSES)}|(?<![0-9A-Za-z])(?:{_groups(CODES)})|(?<![0-9])(?=[0-9+(])(?:{_groups(NUMBERS)})"
#: Around a match, before it once for each kind that it is not, and the start of a mark that the text itself has.
MARK, STEP, ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2"
_ESCAPES = {ESCAPE: ESCAPE + "\ufdd5", MARK: ESCAPE + "\ufdd3", STEP: ESCAPE + "\ufdd4"}
#: Kind -> formats that a date of it is tried in.
DATE_FORMATS = {"iso_date": ["y-M-d"], "dot_date": ["d.M.y"], "slash_date": ["M/d/y", "d/M/y"]}


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def feistel(x: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """The keyed permutation of 0 <= x < a * b."""

    def permute(v: Column) -> Column:
        a, b = v["a"], v["b"]

        def keyed(value: Column, turn: Column, modulus: Column) -> Column:
            text = F.concat_ws("|", v["head"], turn, value)
            return _long(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10)) % modulus

        def turn(s: Column, i: Column) -> Column:
            left = F.struct(((s["l"] + keyed(s["r"], i, a)) % a).alias("l"), s["r"].alias("r"))
            right = F.struct(s["l"].alias("l"), ((s["r"] + keyed(s["l"], i, b)) % b).alias("r"))
            return F.when(i % 2 == 0, left).otherwise(right)

        start = F.struct(_long(_div(v["x"], b)).alias("l"), _long(v["x"] % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])

    return let(F.struct(x.alias("x"), a.alias("a"), b.alias("b"), F.concat_ws("|", F.lit(key), tweak, a, b).alias("head")), permute)


def permuted(text: Column, radix: int, tweak: str, key: str) -> Column:
    """The digits of `text` in base `radix`, permuted among all strings of their length (by chunks of under 2^62)."""
    chunk = {10: 18, 16: 14, 36: 10}[radix]

    def part(t: Column, i: Column) -> Column:
        digits = F.substr(t, i * chunk + 1, F.lit(chunk))
        n = F.length(digits)
        a, b = (_long(F.round(F.pow(F.lit(float(radix)), f))) for f in (F.ceil(n / 2), F.floor(n / 2)))
        new = feistel(_long(F.conv(digits, radix, 10)), a, b, F.concat_ws("|", F.lit(tweak), i, F.length(t)), key)
        return F.lpad(F.lower(F.conv(new.cast("string"), 10, radix)), n, F.lit("0"))

    def whole(t: Column) -> Column:
        chunks = F.sequence(F.lit(0), _long(F.ceil(F.length(t) / chunk)).cast("int") - 1)
        return F.when(F.length(t) == 0, t).otherwise(F.array_join(F.transform(chunks, lambda i: part(t, i)), ""))

    return let(text, whole)


def filled(template: Column, places: str, content: Column) -> Column:
    """template with its characters of class [places] replaced, in order, by those of content."""

    def one(v: Column, i: Column) -> Column:
        c = F.substr(v["template"], i, F.lit(1))
        at = F.length(F.regexp_replace(F.substr(v["template"], F.lit(1), i), f"[^{places}]", ""))
        return F.when(c.rlike(f"[{places}]"), F.substr(v["content"], at, F.lit(1))).otherwise(c)

    both = F.struct(template.alias("template"), content.alias("content"))
    return let(both, lambda v: F.array_join(F.transform(F.sequence(F.lit(1), F.length(v["template"])), lambda i: one(v, i)), ""))


def luhn_sum(digits: Column, first: int) -> Column:
    """Sum from the right; the last digit stands at place `first` (1: a whole number, 2: one without its check digit)."""

    def add(t: Column, total: Column, i: Column) -> Column:
        d = F.substr(t, F.length(t) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((i + first) % 2 == 1, twice).otherwise(d)

    return let(digits, lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda total, i: add(t, total, i)))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of one match; the match itself where validation fails."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), permuted(F.substr(digits, F.lit(2), n - 2), 10, "card", key))
    checked = let(body, lambda d: F.concat(d, ((10 - luhn_sum(d, 2) % 10) % 10).cast("string")))
    card = F.when(luhn_sum(digits, 1) % 10 == 0, filled(m, "0-9", checked)).otherwise(m)

    kept = F.when(m.startswith("+"), F.lit(1)).otherwise(F.lit(0))
    phone = filled(m, "0-9", F.concat(F.substr(digits, F.lit(1), kept), permuted(F.substr(digits, kept + 1, n), 10, "phone", key)))

    area, group, serial = (F.substr(digits, F.lit(i), F.lit(k)).cast("long") for i, k in ((1, 3), (4, 2), (6, 4)))
    place = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1

    def written(moved: Column) -> Column:
        front = _div(moved, _long(9999))
        new_area = _div(front, _long(99)) + 1
        return F.format_string("%03d-%02d-%04d", new_area + (new_area > 665).cast("long"), front % 99 + 1, moved % 9999 + 1)

    ssn = let(feistel(place, _long(898 * 99), _long(9999), F.lit("ssn"), key), written)

    octets = F.split(m, r"\.")
    address = sum((F.get(octets, F.lit(i)).cast("long") * 256 ** (3 - i) for i in range(4)), _long(0))
    ip = let(feistel(address, _long(65536), _long(65536), F.lit("ip"), key), lambda x: F.concat_ws(".", *[(F.shiftright(x, 8 * (3 - i)) % 256).cast("string") for i in range(4)]))

    def date(name: str) -> Column:
        padded = m.rlike("^(?:[0-9]{4}-)?[0-9]{2}[-./][0-9]{2}(?:[./][0-9]{4})?$")

        def moved(form: str) -> Column:
            number = _long(F.datediff(F.try_to_date(m, form), F.lit(FIRST_DAY).cast("date")))
            day = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(number, *map(_long, DATE_SIDES), F.lit("date"), key).cast("int"))
            short = form.replace("y", "yyyy")
            long = short.replace("M", "MM").replace("d", "dd")
            fits = (number >= 0) & (number < DATE_SIDES[0] * DATE_SIDES[1])
            return F.when(fits, let(day, lambda d: F.when(padded, F.date_format(d, long)).otherwise(F.date_format(d, short))))

        return F.coalesce(*map(moved, DATE_FORMATS[name]), m)

    cased = lambda text: let(text, lambda x: F.when(m == F.upper(m), F.upper(x)).otherwise(x))
    local, domain = F.regexp_extract(m, "^([^@]*)@", 1), F.regexp_extract(m, "(@.*)$", 1)
    name = permuted(F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", "")), 36, "email", key)
    email = F.concat(cased(filled(local, "A-Za-z0-9", name)), domain)
    secret = cased(permuted(F.lower(m), 16, "secret", key))
    access_key = F.concat(F.substring(m, 1, 4), F.upper(permuted(F.lower(F.substring(m, 5, 16)), 36, "access_key", key)))

    whole = F.regexp_replace(m, " ", "")
    country, account = F.substring(whole, 1, 2), F.substr(whole, F.lit(5))
    moved_account = filled(account, "0-9", permuted(F.regexp_replace(account, "[^0-9]", ""), 10, "iban", key))
    checked_account = let(moved_account, lambda x: F.concat(country, F.lpad((98 - modulo_97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
    iban = F.when(modulo_97(F.concat(account, F.substring(whole, 1, 4))) == 1, filled(m, "0-9A-Z", checked_account)).otherwise(m)
    ipv6 = filled(m, "0-9A-Fa-f", cased(permuted(F.lower(F.regexp_replace(m, ":", "")), 16, "ipv6", key)))

    made = {"email": email, "secret": secret, "access_key": access_key, "iban": iban, "ipv6": ipv6, "ssn": ssn, "ip": ip, "phone": phone, "card": card} | {k: date(k) for k in DATE_FORMATS}
    return F.coalesce(*[F.when(kind == k, v) for k, v in made.items()], m)


def modulo_97(text: Column) -> Column:
    """Remainder of the number that digits, and letters as 10 to 35, spell."""

    def add(t: Column, r: Column, i: Column) -> Column:
        c = F.ascii(F.substr(t, i, F.lit(1)))
        return F.when(c < 58, (r * 10 + c - 48) % 97).otherwise((r * 100 + c - 55) % 97)

    return let(text, lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda r, i: add(t, r, i)))


def pieces_of(text: Column) -> Column:
    """The text cut at its matches: what is between them, and in every second place a match after as many STEPs as
    its kind's number."""
    escaped = text
    for c, code in _ESCAPES.items():
        escaped = F.replace(escaped, F.lit(c), F.lit(code))
    plain = F.when(text.rlike(f"[{MARK}{STEP}{ESCAPE}]"), escaped).otherwise(text)
    shown = MARK + STEP.join(f"${i + 1}" for i in range(len(KINDS))) + MARK
    return F.split(F.regexp_replace(plain, ANY, shown), MARK, -1)


def restored(piece: Column) -> Column:
    out = piece
    for c, code in reversed(_ESCAPES.items()):
        out = F.replace(out, F.lit(code), F.lit(c))
    return F.when(F.contains(piece, F.lit(ESCAPE)), out).otherwise(piece)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", spans_col: str = "private", count_col: str = "n_private") -> DataFrame:
    """docs with its text replaced, and count_col and spans_col added: how many values were replaced, and
    array of struct(kind, start, length, pseudonym), start counted in characters of the new text from 0.

    `key` is the secret of the permutation; under another key all pseudonyms differ.
    """
    pieces, result = fresh(docs, "pieces"), fresh(docs, "result")
    text = F.col(text_col)
    cut = F.when(text.rlike("[0-9@]"), pieces_of(text))
    parts = F.transform(F.filter(pieces, lambda _, i: i % 2 == 0), restored)
    marked = F.filter(pieces, lambda _, i: i % 2 == 1)

    def one(m: Column) -> Column:
        kind = F.get(F.array(*map(F.lit, KINDS)), F.length(m) - F.length(F.ltrim(m, F.lit(STEP))))
        return let(F.struct(kind.alias("kind"), F.btrim(m, F.lit(STEP)).alias("was")), lambda x: F.struct(x["kind"].alias("kind"), x["was"].alias("was"), pseudonym(x["was"], x["kind"], key).alias("now")))

    def assembled(p: Column, made: Column) -> Column:
        """text and spans from the parts between matches and the matches."""

        def add(s: Column, i: Column) -> Column:
            return let(
                F.get(made, i),
                lambda x: F.struct(
                    F.concat(s["spans"], F.when(x["was"] != x["now"], F.array(F.struct(x["kind"].alias("kind"), s["end"].alias("start"), F.length(x["now"]).alias("length"), x["now"].alias("pseudonym")))).otherwise(F.array().cast(SPANS))).alias("spans"),
                    (s["end"] + F.length(x["now"]) + F.length(F.get(p, i + 1))).alias("end"),
                ),
            )

        start = F.struct(F.array().cast(SPANS).alias("spans"), F.length(F.get(p, F.lit(0))).alias("end"))
        spans = F.aggregate(F.sequence(F.lit(0), F.size(made) - 1), start, add, lambda s: s["spans"])
        pieces = F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.get(made, i - 1)["now"], x)))
        return F.struct(F.array_join(pieces, "").alias("text"), spans.alias("spans"))

    made = let(F.struct(parts.alias("p"), F.transform(marked, one).alias("made")), lambda x: assembled(x["p"], x["made"]))
    out = docs.withColumn(pieces, cut).withColumn(result, F.when(F.size(pieces) > 1, made))
    spans = F.coalesce(F.col(f"`{result}`.spans"), F.array().cast(SPANS))
    new = {text_col: F.coalesce(F.col(f"`{result}`.text"), text), spans_col: spans, count_col: F.size(spans).cast("long")}
    return out.withColumns(new).drop(pieces, result)
