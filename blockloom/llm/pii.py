"""Personal data: validated values are replaced by keyed permutations of the same format.

Every number goes through a Feistel network over its own digits, every name or secret through one over its characters, so the
mapping is one to one, valid values become valid ones, and equal values get equal pseudonyms in all documents under the same
key. Built from DataFrame functions only; no shuffle.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, table

ROUNDS = 8
#: Candidate patterns, in the order of preference at a place (fixed values).
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-À-ɏ])[A-Za-z0-9._%+\-À-ɏ]++@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "iso_date": r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])",
    "dot_date": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9.])",
    "slash_date": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
ANY_RE = "|".join(KINDS.values())
#: First and last day of the range in which dates are permuted; a date outside is left alone.
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAYS = 73049
#: Steps of a cycle walk at most; a step stays outside with a probability of 0.64 or less, so all of them with less than 10^-24.
WALK = 128
#: Characters of a class change places among themselves; others stay (fixed values).
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = ("0123456789abcdef",)
#: Ten digits of a North American number: area code and exchange begin with 2 to 9.
NATIONAL = "^[2-9][0-9]{2}[2-9]"


def _prf(key: str, tweak: str, i: Column, half: Column, modulus: Column) -> Column:
    """A keyed function of a round's half, below modulus (at most 10^10)."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def int_div(a: Column, b: Column) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", a, b)


def permute_number(value: Column, left: Column, right: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1: alternating rounds add to the digit of one radix a function of the other."""
    start = F.struct(int_div(value, right).alias("a"), F.pmod(value, right).alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + _prf(key, tweak, i, s["b"], left), left)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _prf(key, tweak, i, s["a"], right), right)).alias("b"))

    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda s: s["a"] * right + s["b"])


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings of as many digits (18 at most)."""
    def of_size(n: Column) -> Column:
        half = int_div(n, F.lit(2))
        ten = lambda k: F.round(F.pow(F.lit(10.0), k)).cast("long")
        return let(F.struct(ten(half).alias("l"), ten(n - half).alias("r")),
                   lambda m: F.lpad(permute_number(digits.cast("long"), m["l"], m["r"], key, tweak).cast("string"), n, F.lit("0")))

    return let(F.length(digits), of_size)


def walk(once, value: Column, inside) -> Column:
    """once() again and again until inside() holds: a permutation of the values inside, if value is one of them."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(value), lambda v, i: F.when(inside(v), v).otherwise(once(v)))


def permute_chars(text: Column, key: str, tweak: str, classes=CLASSES) -> Column:
    """A keyed permutation of the texts that have characters of the same classes at the same places, of any length: Feistel rounds over two halves.

    A round moves each character of one half on within its class, by a keyed function of the other half and the place.
    """
    def moved(half: Column, other: Column, i: Column) -> Column:
        stream = lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), k.cast("string"), other), 256)
        # A digest serves 16 characters, four hex digits each.
        digests = F.transform(F.sequence(F.lit(0), int_div(F.length(half), F.lit(16)).cast("int")), stream)

        def new(digests: Column) -> Column:
            def at(j: Column) -> Column:
                c = F.substring(half, j + 1, F.lit(1))
                step = F.conv(F.substring(digests[int_div(j, F.lit(16)).cast("int")], F.pmod(j, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                out = c
                for alphabet in classes:
                    place = F.instr(F.lit(alphabet), c)
                    out = F.when(place > 0, F.substring(F.lit(alphabet), F.pmod(place - 1 + step, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
                return out

            return F.array_join(F.transform(F.sequence(F.lit(0), F.length(half) - 1), at), "")

        return F.when(F.length(half) == 0, half).otherwise(let(digests, new))

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, moved(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], i)).alias("b"))

    def halved(n: Column) -> Column:
        start = F.struct(F.substring(text, F.lit(1), n).alias("a"), F.substring(text, n + 1, F.length(text)).alias("b"))
        return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda s: F.concat(s["a"], s["b"]))

    return let(int_div(F.length(text), F.lit(2)).cast("int"), halved)


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def refill(mask: Column, digits: Column) -> Column:
    """mask with its digits replaced in turn."""
    part = lambda i: F.substring(mask, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(mask)), lambda i: F.when(
        part(i).rlike("[0-9]"), F.substring(digits, F.length(only_digits(F.substring(mask, F.lit(1), i))), F.lit(1))).otherwise(part(i))), "")


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum; shift 1 if a check digit is still to be appended."""
    def weight(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = F.pmod(i + shift, F.lit(2)) == 1
        return F.when(double & (d > 4), d * 2 - 9).when(double, d * 2).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), weight), F.lit(0), lambda a, b: a + b)


def _card(m: Column, key: str) -> Column:
    """The longest run of the digit groups that has 13 to 19 digits and a right Luhn sum changes; groups beside it (an expiry date, a code) stay."""
    def new(run: Column) -> Column:
        def whole(d: Column) -> Column:
            # 19 digits do not fit a long with their check digit's sum: the payload has 18 at most.
            payload = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
            return let(payload, lambda p: F.concat(p, F.pmod(F.lit(10) - F.pmod(luhn_sum(p, 1), F.lit(10)), F.lit(10)).cast("string")))

        return let(only_digits(run), lambda d: refill(run, whole(d)))

    def pick(parts: Column) -> Column:
        n = F.size(parts)
        text = lambda i, k: F.array_join(F.slice(parts, i, k), "")
        runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.struct(
            only_digits(text(i, k)).alias("d"), (-i).alias("at"), k.alias("k")))))
        # A run of a wrong length has no sum to be right.
        right = lambda r: F.when(F.length(r["d"]).between(13, 19), F.pmod(luhn_sum(r["d"], 0), F.lit(10)) == 0).otherwise(F.lit(False))
        best = F.array_max(F.transform(F.filter(runs, right), lambda r: F.struct(F.length(r["d"]).alias("size"), r["at"].alias("at"), r["k"].alias("k"))))

        def put(r: Column) -> Column:
            i = -r["at"]
            run = text(i, r["k"])
            tail = F.when(run.rlike("[0-9]$"), F.lit("")).otherwise(F.substring(run, -1, 1))
            changed = let(F.regexp_replace(run, r"[ \-]$", ""), new)
            return F.when(r.isNotNull(), F.concat(text(F.lit(1), i - 1), changed, tail, text(i + r["k"], n)))

        return let(best, put)

    return let(F.regexp_extract_all(m, F.lit(r"[0-9]+[ \-]?"), F.lit(0)), pick)


def _phone(m: Column, key: str) -> Column:
    """The number within the country changes, its last ten digits or what follows the first digit of a shorter one; the country code stays, so a number is linked with and without it."""
    def national(d: Column) -> Column:
        once = lambda v: permute_digits(v, key, "phone")
        valid = lambda v: (F.length(v) == 10) & v.rlike(NATIONAL)
        return walk(once, d, lambda v: valid(v) == valid(d))

    def split(d: Column) -> Column:
        own = F.when(m.startswith("+"), F.least(F.length(d) - 1, F.lit(10))).otherwise(F.least(F.length(d), F.lit(10)))
        return let(own, lambda k: refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - k), let(F.substring(d, F.length(d) - k + 1, k), national))))

    return let(only_digits(m), split)


def _ssn(m: Column, key: str) -> Column:
    """Numbered among the valid ones: 898 areas (001 to 899 but 666), 99 groups, 9999 serials."""
    def new(d: Column) -> Column:
        part = lambda at, n: F.substring(d, at, n).cast("long")
        area, group, serial = part(1, 3), part(4, 2), part(6, 4)
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        front = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
        one = lambda n: F.lit(n).cast("long")

        def written(n: Column) -> Column:
            a = int_div(int_div(n, one(9999)), one(99)) + 1
            a = F.when(a >= 666, a + 1).otherwise(a)
            pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
            return F.concat(pad(a, 3), pad(F.pmod(int_div(n, one(9999)), one(99)) + 1, 2), pad(F.pmod(n, one(9999)) + 1, 4))

        return F.when(valid, refill(m, let(permute_number(front * 9999 + serial - 1, one(898 * 99), one(9999), key, "ssn"), written)))

    return let(only_digits(m), new)


def _ip(m: Column, key: str) -> Column:
    def new(parts: Column) -> Column:
        number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
        dotted = lambda n: F.concat_ws(".", *(F.shiftrightunsigned(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))
        return F.when(F.forall(parts, lambda p: (p.cast("int") <= 255)), let(permute_number(number, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip"), dotted))

    return let(F.split(m, r"\."), new)


def _date(m: Column, pattern: str, key: str, late: bool = False) -> Column:
    """The day's number is permuted in 0 .. 271 * 270 - 1, walking until it is below DAYS; late: among days of the month over 12 only, as the form says no more."""
    def new(day: Column) -> Column:
        first = F.lit(FIRST_DAY).cast("date")
        inside = day.between(first, F.lit(LAST_DAY).cast("date"))
        once = lambda v: permute_number(v, F.lit(271).cast("long"), F.lit(270).cast("long"), key, "late date" if late else "date")
        own = lambda v: (v < DAYS) & (F.dayofmonth(F.date_add(first, v.cast("int"))) > 12) if late else v < DAYS
        return F.when(inside, let(let(F.datediff(day, first).cast("long"), lambda n: walk(once, n, own)),
                                  lambda n: F.date_format(F.date_add(first, n.cast("int")), pattern)))

    return let(F.try_to_date(m, pattern), new)


def _email(m: Column, key: str) -> Column:
    """Letters and digits before the @ change within their kind; the domain stays. Names at the same domain stay apart."""
    return let(F.instr(m, "@"), lambda p: F.concat(let(F.substring(m, F.lit(1), p - 1), lambda own: permute_chars(own, key, "email")), F.substring(m, p, F.length(m))))


def _secret(m: Column, key: str) -> Column:
    """Hex digits change; a value all of digits is no secret."""
    return F.when(m.rlike("[a-f]"), permute_chars(m, key, "secret", HEX))


def pseudonym(m: Column, key: str) -> Column:
    """(kind, new text) for a candidate; kind null and the text as it was if the value is not valid."""
    is_a = lambda k: m.rlike(f"^(?:{KINDS[k]})$")
    ways = {
        "email": _email(m, key), "iso_date": _date(m, "yyyy-MM-dd", key), "dot_date": _date(m, "dd.MM.yyyy", key),
        "slash_date": F.coalesce(_date(m, "MM/dd/yyyy", key), _date(m, "dd/MM/yyyy", key, late=True)), "ip": _ip(m, key),
        "phone": _phone(m, key), "ssn": _ssn(m, key), "card": _card(m, key), "secret": _secret(m, key),
    }
    kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in reversed(KINDS):
        new = F.when(is_a(k), ways[k]).otherwise(new)
        kind = F.when(is_a(k), F.lit(k)).otherwise(kind)
    return let(new, lambda n: F.struct(F.when(n.isNotNull(), kind).alias("kind"), F.coalesce(n, m).alias("text")))


def redact(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_found (values replaced), kinds (their distinct names, sorted) and text with pseudonyms.

    Candidates that fail validation (Luhn sum, calendar, octets, reserved numbers) stay. Null texts stay null with
    no finds. Of candidates that overlap the one that begins first counts, at one place the kind that KINDS has first. A date
    written as month/day is linked with the other forms; day/month with a day over 12 has pseudonyms of its own.
    Rows are judged one by one, long texts whole: repeated rows and null ids each give a row; an empty table gives an empty one. Other columns are not read.
    """
    def filled(found: Column) -> Column:
        gaps = F.split(F.col("text"), ANY_RE, -1)
        joined = F.array_join(F.zip_with(gaps, F.concat(found["text"], F.array(F.lit(""))), lambda g, f: F.concat(g, f)), "")
        kinds = F.filter(found["kind"], lambda k: k.isNotNull())
        return F.struct(F.size(kinds).cast("long").alias("n_found"), F.array_join(F.sort_array(F.array_distinct(kinds)), ",").alias("kinds"), joined.alias("text"))

    matches = F.regexp_extract_all("text", F.lit(ANY_RE), F.lit(0))
    none = F.struct(F.lit(0).cast("long").alias("n_found"), F.lit("").alias("kinds"), F.col("text").alias("text"))
    x = F.when(F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False)), let(F.transform(matches, lambda m: pseudonym(m, key)), filled)).otherwise(none)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", x.alias("x")).select("doc_id", "x.*")


#: The query's key where the session sets none: new with each driver, so that nobody knows it.
_OWN_KEY = secrets.token_hex(32)


def op9_pii(spark, sf_dir):
    """The key is the session's spark.pii.key; set it to link pseudonyms across runs."""
    return redact(table(spark, sf_dir, "documents"), spark.conf.get("spark.pii.key", None) or _OWN_KEY)
