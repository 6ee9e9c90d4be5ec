"""Format-preserving pseudonyms for personal data, by Feistel networks; DataFrame functions only.

Found and checked: card numbers (13 to 19 digits, four groups of four, or groups of four, six and five, with a right
Luhn digit), IBANs (in one piece or in groups of four, with the right remainder of 97), IPv4 addresses (octets up to
255), phone numbers with an area code in brackets or in the form 123-456-7890, social security numbers in the form
123-45-6789 (no part all zeros, no area 666 or from 900), dates of the years 1900 to 2299 that exist (2024-01-31,
31.01.2024, 01/31/2024, or 31/01/2024 where that alone exists), e-mail addresses, and values of 16 or more characters,
however long, that are assigned to a token, key, secret or password. What fails its check stays as it is.

Each is permuted by a keyed Feistel network within its format: digits stay digits and letters letters of their case,
separators stay in place, card numbers get a right Luhn digit and IBANs right check digits, octets stay octets and
dates dates. The network is a bijection, so different values have different pseudonyms; it depends on the value and
the key alone, so equal values stay linked in all documents, cards and IBANs also when they are written with other
separators. Dates are numbered within the 400 years, a domain of 189 x 773 days, which the network's halves fit
exactly; no value needs a second try. E-mail addresses keep their domain, phone numbers their country code, IBANs
their country.

Cases: null text stays null. Texts of any length are read whole; a pattern's groups repeat a bounded number of times
(a host name has 127 labels at most), so no text exhausts the matcher. Nothing depends on other rows, so repeated rows,
ties and empty tables need no rule. Extra columns stay, whatever their names; one named like a result (n_<kind>) is
replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Half of the longest value whose halves are hashed as they are.
LONG = 256
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind -> pattern; the first kind that matches at a place has it.
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\\.){1,127}(?:[A-Za-z]{2,}+|(?i:xn--)[A-Za-z0-9-]++)(?![A-Za-z0-9-])",
    "secret": "(?i:\\b(?:token|secret|password|api[_-]?key|access[_-]?key)\\s{0,3}[=:]\\s{0,3}[\"']?[A-Za-z0-9+/_-]{16,}+)",
    "ip": f"(?<![0-9.]){_OCTET}(?:\\.{_OCTET}){{3}}(?![0-9]|\\.[0-9])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "card": "(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])",
    "phone": "(?:(?<![0-9])\\+[0-9]{1,3} )?\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": "(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "date": "(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\\.[0-9]{2}\\.[0-9]{4})(?![0-9])",
}
PATTERN = "|".join(PATTERNS.values())
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, DAYS = "1900-01-01", (189, 773)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda's variable is not replaced by what it stands for."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _keyed(key: str, *parts: Column) -> Column:
    """A number from 0 to 2^40 - 1 from the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 10), 16, 10).cast("long")


def feistel_number(left: Column, right: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """Permute (left, right) of the domain sizes[0] x sizes[1]; a struct l, r."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(x: Column, i: Column) -> Column:
        even = (x["l"] + _keyed(key, F.lit(kind), i, x["r"])) % sizes[0]
        odd = (x["r"] + _keyed(key, F.lit(kind), i, x["l"])) % sizes[1]
        return F.struct(F.when(i % 2 == 0, even).otherwise(x["l"]).alias("l"), F.when(i % 2 == 1, odd).otherwise(x["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def feistel_string(s: Column, key: str, kind: str, hexadecimal: Column | None = None) -> Column:
    """Permute the digits and letters of a string: each half in turn is shifted, letter by letter, by what the other half gives."""
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal

    def shifted(part: Column, other: Column, i: Column) -> Column:
        def letter(c: Column, k: Column, other: Column) -> Column:
            return let(alphabet_of(c), lambda alphabet: moved(c, alphabet, k + 1, other))

        def alphabet_of(c: Column) -> Column:
            lower, upper = F.when(hexadecimal, F.lit(LOWER[:6])).otherwise(LOWER), F.when(hexadecimal, F.lit(UPPER[:6])).otherwise(UPPER)
            return F.when(c.between("0", "9"), F.lit(DIGITS)).when(c.between("a", "z"), lower).when(c.between("A", "Z"), upper).otherwise(c)

        def moved(c: Column, alphabet: Column, k: Column, other: Column) -> Column:
            place = F.instr(alphabet, c)
            return F.substring(alphabet, ((place - 1 + _keyed(key, F.lit(kind), i, k, other)) % F.length(alphabet) + 1).cast("int"), F.lit(1))

        # a long half counts by its digest, and letters are cut once: the work is linear in the length
        brief = F.when(F.length(other) > LONG, F.sha2(other, 256)).otherwise(other)
        new = let(brief, lambda o: F.array_join(F.transform(F.split(part, ""), lambda c, k: letter(c, k, o)), ""))
        return F.when(F.length(part) == 0, part).otherwise(new)

    def step(x: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, shifted(x["l"], x["r"], i)).otherwise(x["l"]).alias("l"), F.when(i % 2 == 1, shifted(x["r"], x["l"], i)).otherwise(x["r"]).alias("r"))

    def network(s: Column) -> Column:
        half = F.floor(F.length(s) / 2).cast("int")
        start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["l"], x["r"]))

    return let(s, network)


def _digit_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum; the places that are doubled count `doubled` (0 or 1) from the right, modulo 2."""

    def total(digits: Column) -> Column:
        n = F.length(digits)

        def value(k: Column) -> Column:
            d = F.substring(digits, k, F.lit(1)).cast("int")
            return F.when((n - k) % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

        return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, b: a + b)

    return let(digits, total)


def _remainder(s: Column) -> Column:
    """Of 97: s read as a number, in which A to Z stand for 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        value = F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
        return F.when(value < 10, (r * 10 + value) % 97).otherwise((r * 100 + value) % 97).cast("int")

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _iban_holds(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return let(plain, lambda p: (F.length(p) >= 15) & (F.length(p) <= 34) & (_remainder(F.concat(F.substring(p, 5, 34), F.substring(p, 1, 4))) == 1))


def _refill(form: Column, digits: Column, wanted: tuple[str, str] = ("0", "9")) -> Column:
    """form with its digits (or what lies between the characters wanted) replaced, in order, by digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def filled(digits: Column) -> Column:
        def step(x: Column, k: Column) -> Column:
            c = F.substring(form, k, F.lit(1))
            number = c.between(*wanted)
            return F.struct(F.concat(x["out"], F.when(number, F.substring(digits, x["next"], F.lit(1))).otherwise(c)).alias("out"), F.when(number, x["next"] + 1).otherwise(x["next"]).alias("next"))

        return F.aggregate(F.sequence(F.lit(1), F.length(form)), start, step, lambda x: x["out"])

    return let(digits, filled)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    body = let(_only_digits(m), lambda d: feistel_string(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"))
    return _refill(m, let(body, lambda b: F.concat(b, ((10 - _digit_sum(b, 0) % 10) % 10).cast("string"))))


def _iban(m: Column, key: str) -> Column:
    def remade(p: Column, body: Column) -> Column:
        check = F.lpad((98 - _remainder(F.concat(body, F.substring(p, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(p, 1, 2), check, body)

    plain = F.replace(m, F.lit(" "), F.lit(""))
    new = let(plain, lambda p: let(feistel_string(F.substring(p, 5, 34), key, "iban"), lambda body: remade(p, body)))
    return _refill(m, new, ("0", "Z"))


def _ssn(m: Column, key: str) -> Column:
    """Areas 1 to 899 without 666, groups 1 to 99 and serials 1 to 9999, numbered without gaps."""
    area = F.substring(m, 1, 3).cast("long")
    rest = (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1
    p = feistel_number(area - F.when(area > 666, 2).otherwise(1), rest, (898, 99 * 9999), key, "ssn")
    two = lambda n, width: F.lpad(n.cast("string"), width, "0")
    return let(p, lambda x: F.concat_ws("-", two(x["l"] + F.when(x["l"] >= 665, 2).otherwise(1), 3), two(F.floor(x["r"] / 9999) + 1, 2), two(x["r"] % 9999 + 1, 4)))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("long"))
    p = let(octets, lambda o: feistel_number(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), (65536, 65536), key, "ip"))
    part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return let(p, lambda x: F.concat_ws(".", part(x["l"]), part(x["r"])))


def _phone(m: Column, key: str) -> Column:
    number = F.regexp_extract(m, "\\(?[0-9]{3}\\)?[ -][0-9]{3}-[0-9]{4}$", 0)
    return let(number, lambda local: F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(local)), _refill(local, feistel_string(_only_digits(local), key, "phone"))))


def _day(m: Column) -> Column:
    """The date, or null."""
    read = lambda form: F.try_to_timestamp(m, F.lit(form)).cast("date")
    day = F.when(m.contains("-"), read("yyyy-MM-dd")).when(m.contains("."), read("dd.MM.yyyy")).otherwise(F.coalesce(read("MM/dd/yyyy"), read("dd/MM/yyyy")))
    return F.when((day >= F.lit(FIRST_DAY).cast("date")) & (day < F.lit("2300-01-01").cast("date")), day)


def _date(m: Column, key: str) -> Column:
    n = F.date_diff(_day(m), F.lit(FIRST_DAY).cast("date"))
    p = let(n, lambda n: feistel_number(F.floor(n / DAYS[1]), n % DAYS[1], DAYS, key, "date"))
    new = let(p, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x["l"] * DAYS[1] + x["r"]).cast("int")))
    american = F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).isNotNull()
    form = F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").when(american, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    shown = lambda day: {f: F.date_format(day, f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")}
    return let(F.struct(new.alias("day"), form.alias("form")), lambda x: _choose(x["form"], shown(x["day"])))


def _choose(c: Column, out: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in out.items()])


def _email(m: Column, key: str) -> Column:
    return let(F.substring_index(m, "@", 1), lambda local: F.concat(feistel_string(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m))))


def _secret(m: Column, key: str) -> Column:
    hexadecimal = m.rlike("(?:^|[^0-9A-Za-z+/_-])(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")
    masked = lambda hexa, value: F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), feistel_string(value, key, "secret", hexa))
    return let(F.regexp_extract(m, "[A-Za-z0-9+/_-]{16,}$", 0), lambda value: let(hexadecimal, lambda hexa: masked(hexa, value)))


def kind_of(m: Column) -> Column:
    """The kind of a match whose check holds, else null."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    kind = F.when(m.contains("@"), "email").when(whole("secret"), "secret").when(whole("ip"), "ip").when(whole("iban"), F.when(_iban_holds(m), "iban"))
    kind = kind.when(whole("card"), F.when(_digit_sum(_only_digits(m), 1) % 10 == 0, "card")).when(whole("phone"), "phone").when(whole("ssn"), "ssn")
    return kind.when(whole("date"), F.when(_day(m).isNotNull(), "date"))


MASKS = {"email": _email, "secret": _secret, "ip": _ip, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "date": _date}


def pseudonyms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with its personal data replaced in text, and n_<kind>, the number of each kind that was replaced."""
    found = F.transform(F.regexp_extract_all(f"`{text}`", F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    # the columns of docs travel as one, so that none clashes with those used here; exploding an array of one keeps the
    # optimizer from computing the matches anew for every use
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    d = docs.select(rest, F.col(f"`{text}`").alias("text"), F.explode(F.array(F.coalesce(found, F.array().cast("array<struct<m:string,kind:string>>")))).alias("found"))

    def masked(x: Column) -> Column:
        out = None
        for kind, mask in MASKS.items():
            out = (F if out is None else out).when(x["kind"] == kind, mask(x["m"], key))
        return out.otherwise(x["m"])

    new = F.array_append(F.transform("found", masked), F.lit(""))
    parts = F.zip_with(F.split("text", PATTERN, -1), new, lambda a, b: F.array(a, b))
    of_kind = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    changed = F.exists("found", lambda x: x["kind"].isNotNull())
    masked_text = F.when(changed, F.array_join(F.flatten(parts), "")).otherwise(F.col("text"))
    own = [c for c in docs.columns if c not in {f"n_{k}" for k in MASKS}]
    return d.select(*[masked_text.alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in own], *map(of_kind, MASKS))
