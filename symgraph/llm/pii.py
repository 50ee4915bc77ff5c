"""Personal data: generated candidates, boosted trees and calibrated thresholds, in DataFrame functions only.

Generators are regular expressions whose matches and gaps give code-point offsets: the four base
kinds, whose valid matches always stay, and others of high recall, whose spans may overlap each other and the base: runs of digits with marks
between, dotted quads and addresses written so that programs do not find them. Every free candidate (none that overlaps a base span) gets a few
binned features of its format and context. For each kind boosted trees score the candidates; they become CASE expressions,
so all of it is one projection, without a shuffle, and what is found in a text depends on that text alone.

The trees learn from examples whose label is known because they are made (``examples``): personal data in formats other than the base ones,
and dates, amounts, order numbers, versions and prose of the same shapes, in the contexts of four languages, by seeded hashes in Spark. They go
through the same generators and features as texts do. Three in five are fitted on, one in five sets the threshold (the least score at
which ``precision`` of what passes is personal data), one in five is left for tests. No text of the corpus is learned from.

The patterns use possessive and lazy single-class loops, which give the same matches as the plain ones and
need neither deep recursion nor quadratic time on long runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?=[ -]?[0-9])[0-9 -]+?(?![0-9]|[ -][0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Of high recall: digits with any marks between, and without blanks.
_NUMBER = r"(?<![0-9+.A-Za-z])[0-9(][0-9 ()./-]{5,38}[0-9](?![0-9A-Za-z])"
_BLOCK = r"(?<![0-9+.A-Za-z/-])[0-9][0-9./-]{5,30}[0-9](?![0-9A-Za-z])"
_POINT = r"(?: ?[\[({](?:\.|dot)[\])}] ?| dot | \. )"
_QUAD = rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:{_POINT}[0-9]{{1,3}}){{3}}(?![0-9])"
_AT = r"(?: ?[\[({<](?:at|@)[\])}>] ?| at | @ )"
_DISGUISED = rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:(?:{_POINT}|\.)[A-Za-z0-9-]{{2,63}}+){{1,4}}"
_OCTET = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})|0++)"
_NEAR = r"(?:[a-zéü]{0,10}[ .:=#(-]{1,4}){0,2}$"
#: What stands before a span: words of telephones, cards, hosts and mail, and of other numbers, in four languages.
CONTEXTS = {
    "phone": r"\b(?:tel|tél|phone|fon|fax|call|ring|mobil|móvil|llama|cell|handy|whatsapp|appele|rufen|kontakt|contact)" + _NEAR,
    "card": r"\b(?:card|visa|master|amex|credit|kredit|tarjeta|karte|carte)" + _NEAR,
    "ip": r"\b(?:ip|host|server|addr|adres|ping|gateway|dns|router|node)" + _NEAR,
    "email": r"\b(?:e-?mail|mail|write|schreib|escrib|écri|contact|kontakt|reach|courriel|correo)" + _NEAR,
    "other": r"(?:\b(?:order|invoice|isbn|date|no|nr|num|ref|id|version|ver|rechnung|bestell|factura|pedido|facture|commande|total|sum|from|page|chapter|section|kapitel|seite)[a-zé]{0,8}[ .:=#-]{0,4}|[§$€£#] ?)$",
}
TLDS = "com org net edu gov info io de es fr uk eu ch at it nl example test".split()
_SIDE = {"prev": 3, "next": 3}
#: Features by generator.
NUMBER_FEATURES = ("digits", "groups", "dots", "hyphens", "slashes", "paren", "blanks", "first", "last", "fours", "date", "luhn", "phone", "card", "other", *_SIDE)
QUAD_FEATURES = ("points", "octets", "ip", "other", *_SIDE)
EMAIL_FEATURES = ("at", "points", "labels", "tld", "local", "email", *_SIDE)
#: (kind, generators, features, what no score makes up for: the checks of the base kind)
MODELS = (
    ("card", ("number", "block"), NUMBER_FEATURES, lambda x: x["luhn"] == 1),
    ("phone", ("number", "block"), NUMBER_FEATURES, lambda x: (x["n"] >= 9) & (x["n"] <= 15)),
    ("ip", ("quad",), QUAD_FEATURES, lambda x: x["octets"] == 1),
    ("email", ("disguised",), EMAIL_FEATURES, lambda x: F.lit(True)),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, state: str, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each of the values. They are gathered by chunks, so that appending to arrays stays cheap for many values."""
    one, chunk = F.array().cast(f"array<{state}>"), 64

    def inner(acc: Column, x: Column) -> Column:
        return let(step(acc["now"], x), lambda s: F.struct(s.alias("now"), F.concat(acc["out"], F.array(s)).alias("out")))

    def outer(acc: Column, b: Column) -> Column:
        own = F.aggregate(F.slice(values, b * chunk + 1, F.lit(chunk)), F.struct(acc["now"].alias("now"), one.alias("out")), inner)
        return let(own, lambda o: F.struct(o["now"].alias("now"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

    zero = F.struct(start.cast(state).alias("now"), F.array().cast(f"array<array<{state}>>").alias("out"))
    last = F.floor((F.size(values) - 1) / chunk).cast("int")
    return F.when(F.size(values) > 0, F.aggregate(F.sequence(F.lit(0), last), zero, outer, lambda acc: F.flatten(acc["out"]))).otherwise(one)


def occurrences(text: Column, pattern: str, kind: str) -> Column:
    """array<struct(start, end, kind, match, before, after)>: the matches with code-point offsets and what stands around them."""
    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def rows(p: Column) -> Column:
        gap = lambda k: F.get(p["g"], k)
        lengths = F.transform(p["m"], lambda m, k: F.length(gap(k)) + F.length(m))
        return let(running(lengths, F.lit(0), "int", lambda now, n: now + n), lambda ends: F.transform(p["m"], lambda m, k: F.struct((F.get(ends, k) - F.length(m)).alias("start"), F.get(ends, k).alias("end"), F.lit(kind).alias("kind"), m.alias("match"), F.right(gap(k), F.lit(40)).alias("before"), F.left(gap(k + 1), F.lit(2)).alias("after"))))

    return let(parts, rows)


def _luhn_sum(digits: Column) -> Column:
    """For up to 19 digits."""
    padded, total = F.lpad(digits, 19, "0"), F.lit(0)
    for i in range(19):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if i % 2 == 0 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """array<struct(start, end, kind)> of the base kinds' valid matches, by start and then kind as listed."""
    luhn = lambda d: (F.length(d) >= 12) & (F.length(d) <= 19) & (_luhn_sum(d) == 0)
    phone = lambda d: (F.length(d) >= 9) & (F.length(d) <= 15)
    kept = {
        "email": occurrences(text, _EMAIL, "email"),
        "ip": F.filter(occurrences(text, _IP, "ip"), lambda x: x["match"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        "card": F.filter(occurrences(text, _CARD, "card"), lambda x: let(_digits(x["match"]), luhn)),
        "phone": F.filter(occurrences(text, _PHONE, "phone"), lambda x: let(_digits(x["match"]), phone)),
    }
    needs = {"email": text.contains("@"), "ip": text.contains("."), "card": text.rlike("[0-9]"), "phone": text.contains("+")}  # each pattern implies it
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    own = lambda i, k: F.when(needs[k], F.transform(kept[k], lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))).otherwise(empty)
    return F.array_sort(F.concat(*[own(i, k) for i, k in enumerate(KINDS)]))


def free_candidates(text: Column, base: Column) -> Column:
    """The other generators' matches that overlap no base span, in the order of start, longer ones first."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,match:string,before:string,after:string>>")
    own = lambda needs, pattern, kind: F.when(text.rlike(needs), occurrences(text, pattern, kind)).otherwise(empty)
    found = F.concat(
        own("[0-9]", _NUMBER, "number"), own("[0-9]", _BLOCK, "block"),
        own(r"(?i)[0-9] ?(?:[\[({]|dot|\.)", _QUAD, "quad"), own(r"(?i)[\[({< ](?:at|@)[\])}> ]", _DISGUISED, "disguised"),
    )
    # all spans by start: a base span that ends after a candidate's start comes before it, or begins before its end
    marked = F.concat(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind"), x.alias("c"))), F.transform(base, lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("less"), b["kind"].alias("kind"), F.lit(None).cast("struct<start:int,end:int,kind:string,match:string,before:string,after:string>").alias("c"))))

    def free(all_: Column) -> Column:
        is_base = lambda x: x["c"].isNull()
        before = running(all_, F.lit(-1), "int", lambda now, x: F.when(is_base(x), F.greatest(now, -x["less"])).otherwise(now))
        after = running(F.reverse(all_), F.lit(2**31 - 1), "int", lambda now, x: F.when(is_base(x), F.least(now, x["start"])).otherwise(now))
        whole = F.struct(before.alias("b"), F.reverse(after).alias("a"))
        clear = lambda w: F.filter(all_, lambda x, k: ~is_base(x) & (F.get(w["b"], k) <= x["start"]) & (F.get(w["a"], k) >= -x["less"]))
        return let(whole, lambda w: F.transform(clear(w), lambda x: x["c"]))

    return F.when(F.size(found) > 0, let(F.sort_array(marked), free)).otherwise(empty)


def features(c: Column) -> Column:
    """A candidate's binned features; those of other generators do no harm."""
    bins = lambda x, *edges: sum((x >= e).cast("int") for e in edges)
    m = c["match"]
    of = lambda pattern: F.regexp_count(m, F.lit(pattern))
    side = lambda x: F.when(x.rlike(r"^[\x20\x09-\x0D]?$"), 0).when(x.rlike("[A-Za-z0-9]"), 1).otherwise(2)
    near = lambda kind: c["before"].rlike("(?i)" + CONTEXTS[kind]).cast("int").alias(kind)
    groups = F.split(F.regexp_replace(F.regexp_replace(m, "^[^0-9]+", ""), "[^0-9]+$", ""), "[^0-9]+")
    labels = F.split(F.element_at(F.split(m, "(?i)" + _AT), -1), rf"(?i){_POINT}|\.")
    local = F.element_at(F.split(m, "(?i)" + _AT), 1)
    return let(
        F.struct(_digits(m).alias("d"), groups.alias("g"), labels.alias("l")),
        lambda p: F.struct(
            F.length(p["d"]).alias("n"),
            bins(F.length(p["d"]), 7, 9, 10, 11, 12, 13, 16, 17).alias("digits"),
            bins(F.size(p["g"]), 2, 3, 4, 5).alias("groups"),
            bins(of(r"\."), 1, 2, 3).alias("dots"), bins(of("-"), 1, 2, 3).alias("hyphens"), bins(of("/"), 1, 2, 3).alias("slashes"),
            m.contains("(").cast("int").alias("paren"), bins(of(" "), 1, 2, 4).alias("blanks"),
            F.when(m.startswith("00"), 0).when(m.startswith("0"), 1).when(m.startswith("("), 2).otherwise(3).alias("first"),
            bins(F.length(F.element_at(p["g"], -1)), 3, 4, 5).alias("last"),
            F.forall(p["g"], lambda g: F.length(g) == 4).cast("int").alias("fours"),
            m.rlike(r"(?:^|[^0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})(?:$|[^0-9])").cast("int").alias("date"),
            F.when((F.length(p["d"]) >= 12) & (F.length(p["d"]) <= 19), _luhn_sum(p["d"]) == 0).otherwise(False).cast("int").alias("luhn"),
            F.when(m.rlike(r"[\[({](?:\.|(?i:dot))[\])}]"), 0).when(m.rlike("(?i) dot "), 1).when(m.contains(" . "), 2).otherwise(3).alias("points"),
            ((F.size(p["g"]) == 4) & F.forall(p["g"], lambda g: F.length(g) <= 3) & F.forall(p["g"], lambda g: g.cast("int") <= 255)).cast("int").alias("octets"),
            F.when(m.rlike(r"(?i)[\[({<](?:at|@)"), 0).when(m.contains("@"), 1).otherwise(2).alias("at"),
            bins(F.size(p["l"]), 2, 3, 4).alias("labels"),
            F.lower(F.element_at(p["l"], -1)).isin(TLDS).cast("int").alias("tld"),
            F.when(local.rlike("[0-9._%+-]"), 0).when(F.length(local) <= 2, 1).otherwise(2).alias("local"),
            *[near(k) for k in CONTEXTS],
            side(F.right(c["before"], F.lit(1))).alias("prev"), side(F.left(c["after"], F.lit(1))).alias("next"),
        ),
    )


def boost(table: list[tuple[tuple[int, ...], float, float]], rounds: int = 20, rate: float = 0.5) -> tuple[float, list[tuple]]:
    """Logistic boosting of depth-2 trees over (features, positives, negatives): (start, trees).

    A tree is a leaf value or (feature, most, tree where the feature is at most that, other tree).
    """
    pos, neg = sum(r[1] for r in table), sum(r[2] for r in table)
    start = math.log((pos + 0.5) / (neg + 0.5))
    scores, trees = [start] * len(table), []

    def grow(rows: list[int], grad: list[float], hess: list[float], depth: int):
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        best = None
        if depth:
            for f in range(len(table[0][0])):
                sums: dict[int, list[float]] = {}
                for i in rows:
                    s = sums.setdefault(table[i][0][f], [0.0, 0.0])
                    s[0] += grad[i]
                    s[1] += hess[i]
                a = b = 0.0
                for value in sorted(sums)[:-1]:
                    a += sums[value][0]
                    b += sums[value][1]
                    gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, f, value)
        if best is None:
            return rate * g / (h + 1)
        _, f, value = best
        return f, value, *(grow([i for i in rows if (table[i][0][f] <= value) == low], grad, hess, depth - 1) for low in (True, False))

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        grad = [r[1] - (r[1] + r[2]) * q for r, q in zip(table, p)]
        hess = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(table, p)]
        tree = grow(list(range(len(table))), grad, hess, 2)
        trees.append(tree)
        scores = [s + evaluate(tree, r[0]) for s, r in zip(scores, table)]
    return start, trees


def evaluate(tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def compiled(model: tuple[float, list], names: tuple[str, ...], x: Column) -> Column:
    """The model's score in log odds, as a column over a struct of features."""

    def of(tree) -> Column:
        return F.when(x[names[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

    out = F.lit(model[0])
    for tree in model[1]:
        out = out + of(tree)
    return out


def calibrated(model: tuple[float, list], table: list, precision: float) -> float:
    """The least score at which what passes has the precision; infinity if there is none."""
    scored = sorted(((model[0] + sum(evaluate(t, x) for t in model[1]), p, n) for x, p, n in table), reverse=True)
    pos = neg = 0.0
    threshold = math.inf
    for i, (s, p, n) in enumerate(scored):
        pos, neg = pos + p, neg + n
        if (i + 1 == len(scored) or scored[i + 1][0] < s) and pos and pos / (pos + neg) >= precision:
            threshold = s
    return threshold


#: Made examples, (kind or none, format): # is a digit, $ the check digit of those before, %1 to %4 numbers up to 255, ~ a name, ^ a domain, & its end.
_FORMATS = (
    *[("phone", f) for f in ("(0##) ###-####", "0## ### ####", "0##/#######", "00## ## #######", "1-###-###-####", "###-###-####", "### ### ####", "###.###.####", "0#### ######", "(0####) ###-###", "0##-####-####", "00##-###-###-###", "(###) ###-####", "0# ## ## ## ##", "0#########")],
    *[("card", f) for f in ("####.####.####.###$", "####/####/####/###$", "####  ####  ####  ###$", "#### / #### / #### / ###$", "####.######.####$", "#### - #### - #### - ###$", "###############$", "###############$", "#### #### #### ###$")],
    *[("ip", f) for f in ("%1[.]%2[.]%3[.]%4", "%1(.)%2(.)%3(.)%4", "%1 dot %2 dot %3 dot %4", "%1[dot]%2[dot]%3[dot]%4", "%1[.]%2.%3[.]%4", "%1 . %2 . %3 . %4", "%1{.}%2{.}%3{.}%4")],
    *[("email", f) for f in ("~ (at) ^ (dot) &", "~[at]^.&", "~ at ^ dot &", "~(at)^.&", "~ @ ^ . &", "~ AT ^ DOT &", "~{at}^{dot}&", "~ [at] ^ [dot] &", "~ at ^.&", "~(at)mail.^.&", "~ at mail dot ^ dot &", "~<at>^.&")],
    *[(None, f) for f in (
        "##.##.20##", "20##-##-##", "##/##/20##", "########", "#########", "##########", "############", "978-#-##-######-#", "978##########", "## ### ###", "#.###.###", "0.########", "##.######", "##.#.####", "#.##.###.####",
        "20##-##-## ## ##", "####-####", "## - ## - ##", "# # # # # # # #", "################", "#### #### #### ####", "####.####.####.####", "##.##.####-##.##.####", "20##/20## ##", "### ### ###", "#### ####", "(####) ####", "(20##) ###-###", "####/####/####",
        "1## ## ## 20##", "###-##-####", "######-####", "######/####", "20#######", "20##########", "##-##-##-##-##", "# ## ### #### #####", "##.##.##.##.##", "(#) #### (#) ####", "1.### 2.### 3.###",
        "3##[.]9##[.]%1[.]%2", "%1 . 3## . %3 . 4##", "# . # . # . #", "9## dot 8## dot 7## dot 6##",
        "look at home.Then", "we met at noon. The", "see us at ^.&", "shop at ^.&", "arrive at 10.30", "aimed at users.And", "stay at hotel.It", "sold at once.Er", "look at this dot and that dot", "~ @ home . Then", "was at ^.But", "meet at work dot Tomorrow", "sit (at) the.table", "begin at 12.45", "arrived at ^.When",
    )],
)
#: (kinds it may stand before, text); "" stands before anything.
_BEFORE = {
    "phone": ("Tel.: ", "phone ", "call me at ", "Telefon ", "mi móvil es ", "teléfono: ", "Fax ", "tél. ", "contact us: ", "Rufen Sie an: ", "cell ", "WhatsApp ", "appelez le ", "llama al ", ""),
    "card": ("card ", "my Visa is ", "tarjeta: ", "Kreditkarte ", "carte no ", "credit card number ", "Mastercard ", "Amex: ", ""),
    "ip": ("ip ", "server ", "host: ", "ping ", "IP address ", "gateway = ", "DNS ", ""),
    "email": ("mail ", "e-mail: ", "write to ", "contact ", "schreib an ", "escribe a ", "écrivez à ", "reach me: ", "correo: ", ""),
    "none": ("order ", "invoice no. ", "Nr. ", "ref: ", "ISBN ", "Rechnung ", "factura ", "total ", "from ", "version ", "§ ", "€ ", "page ", "chapter ", "", "", "", "", "", "", ""),
}
_NAMES = "anna john.doe info j_smith7 maria.lopez kontakt sales peter99 k.weber chef laura support dr.no hans m.dupont lee".split()
_DOMAINS = "example acme mail-host firma univ meinshop lopez-hijos server1 data corp".split()
_WORDS = "the of and house river with der und Haus ein nicht la casa que con río le pour maison dans avec one day walked over then 12 7 3.5 404 a".split()


def examples(spark: SparkSession, n: int = 10_000, seed: int = 7) -> DataFrame:
    """``(row, text, kind, start, end, part)``: a made text around one item of a known kind (null: none); part 0 to 2 is to fit on, 3 to calibrate, 4 to test."""
    roll = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(most)).cast("int")
    pick = lambda salt, items: F.element_at(F.array(*[F.lit(x) for x in items]), roll(salt, len(items)) + 1)
    # one item in six is personal data
    true, false = ([f for f in _FORMATS if (f[0] is None) == none] for none in (False, True))
    either = lambda of: F.element_at(F.array(*[F.struct(F.lit(k).cast("string").alias("kind"), F.lit(f).alias("form")) for k, f in of]), roll("format", len(of)) + 1)
    rows = spark.range(n).withColumn("f", F.when(roll("true", 6) == 0, either(true)).otherwise(either(false))).select("id", "f.*")
    digits = F.concat(*[F.lpad(roll(f"digits{k}", 10**9).cast("string"), 9, "0") for k in range(5)])
    filled = F.array_join(F.transform(F.split("form", ""), lambda c, k: F.when(c == "#", F.substring(digits, k % 44 + 1, F.lit(1))).otherwise(c)), "")
    filled = F.regexp_replace(F.regexp_replace(F.regexp_replace(filled, "~", pick("name", _NAMES)), r"\^", pick("domain", _DOMAINS)), "&", pick("tld", TLDS))
    for k in range(1, 5):
        filled = F.replace(filled, F.lit(f"%{k}"), roll(f"octet{k}", 256).cast("string"))
    rows = rows.withColumn("item", filled)
    check = (10 - _luhn_sum(F.concat(_digits(F.col("item")), F.lit("0")))) % 10
    rows = rows.withColumn("item", F.when(F.col("item").contains("$"), F.replace("item", F.lit("$"), check.cast("string"))).otherwise(F.col("item")))
    before = F.lit("")
    for k, own in _BEFORE.items():
        before = F.when(F.coalesce("kind", F.lit("none")) == k, pick(f"before {k}", own)).otherwise(before)
    # prose of other subjects' words stands before some of the rest
    before = F.when(F.col("kind").isNull() & (roll("odd", 8) == 0), pick("odd one", [x for k in KINDS for x in _BEFORE[k]])).otherwise(before)
    some = lambda salt: F.concat_ws(" ", *[pick(f"{salt}{k}", _WORDS) for k in range(4)])
    lead = F.concat(some("lead"), pick("stop", [" ", ", ", ". ", "\n", ": "]), before)
    end = pick("end", [" ", ", ", ". ", "\n", "; ", ") "])
    rows = rows.select("id", "kind", "item", lead.alias("lead"), F.concat("item", end, some("tail")).alias("rest"))
    return rows.select(F.col("id").alias("row"), F.concat("lead", "rest").alias("text"), "kind", F.length("lead").alias("start"), (F.length("lead") + F.length("item")).alias("end"), roll("part", 5).alias("part"))


def labelled(made: DataFrame) -> DataFrame:
    """``(row, part, kind, source, x struct of features)``: the free candidates of made texts; kind is the item's where the candidate is it, else null."""
    spans = made.select("*", base_spans(F.col("text")).alias("base"))
    found = spans.select("row", "part", "kind", "start", "end", F.explode(free_candidates(F.col("text"), F.col("base"))).alias("c"))
    same = (F.abs(F.col("c.start") - F.col("start")) <= 1) & (F.abs(F.col("c.end") - F.col("end")) <= 1)
    return found.select("row", "part", F.when(same, F.col("kind")).alias("kind"), F.col("c.kind").alias("source"), features(F.col("c")).alias("x"))


_fitted: dict[tuple, list] = {}


def fit(spark: SparkSession, precision: float = 0.95, n: int = 10_000, seed: int = 7) -> list[tuple]:
    """(kind, (start, trees), threshold) of each kind, learned once per process; what is collected is bounded by the number of examples."""
    if (precision, n, seed) not in _fitted:
        names = sorted({f for _, _, own, _ in MODELS for f in own})
        known = labelled(examples(spark, n, seed)).where("part < 4").groupBy("source", "kind", (F.col("part") == 3).alias("later"), F.col("x.n").alias("n"), *[F.col(f"x.{f}").alias(f) for f in names]).agg(F.count("*").alias("rows"))
        rows, out = sorted(known.collect(), key=str), []
        for kind, sources, own, gate in MODELS:
            tables: tuple[dict, dict] = ({}, {})
            for r in rows:
                if r["source"] in sources:
                    at = tables[r["later"]].setdefault(tuple(r[f] for f in own), [0.0, 0.0])
                    at[r["kind"] != kind] += r["rows"]
            fit_on, hold = ([(x, p, q) for x, (p, q) in sorted(t.items())] for t in tables)
            model = boost(fit_on)
            out.append((kind, model, calibrated(model, hold, precision)))
        _fitted[precision, n, seed] = out
    return _fitted[precision, n, seed]


def verdict(x: Column, source: Column, models: list[tuple]) -> Column:
    """The kind that a candidate with features ``x`` is taken as, or null."""
    out = F.lit(None).cast("string")
    for (kind, sources, own, gate), (_, model, threshold) in reversed(list(zip(MODELS, models))):
        if threshold < math.inf:
            out = F.when(source.isin(*sources) & gate(x) & (compiled(model, own, x) >= threshold - 1e-9), F.lit(kind)).otherwise(out)
    return out


def spans(text: Column, models: list[tuple]) -> Column:
    """array<struct(start, place, end, kind, base)> of a text's personal data, by start and kind; an added span overlaps no other span."""
    kind_type = "struct<end:int,take:boolean>"

    def added(free: Column) -> Column:
        judged = F.filter(F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), let(features(c), lambda x: verdict(x, c["kind"], models)).alias("kind"))), lambda c: c["kind"].isNotNull())

        def greedy(own: Column) -> Column:
            states = running(own, F.struct(F.lit(0).alias("end"), F.lit(False).alias("take")), kind_type, lambda now, c: F.struct(F.greatest(now["end"], F.when(c["start"] >= now["end"], c["end"]).otherwise(0)).alias("end"), (c["start"] >= now["end"]).alias("take")))
            return let(states, lambda s: F.filter(own, lambda c, k: F.get(s, k)["take"]))

        return let(judged, greedy)

    place = lambda k: (F.array_position(F.array(*map(F.lit, KINDS)), k) - 1).cast("int")
    with_base = lambda base: F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["place"].alias("place"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(True).alias("base")))
    more = lambda base: F.transform(added(free_candidates(text, base)), lambda c: F.struct(c["start"].alias("start"), place(c["kind"]).alias("place"), c["end"].alias("end"), c["kind"].alias("kind"), F.lit(False).alias("base")))
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,base:boolean>>")
    return F.when(text.rlike(r"(?i)[0-9@]|[\[({< ]at[\])}> ]"), let(base_spans(text), lambda base: F.sort_array(F.concat(with_base(base), more(base))))).otherwise(empty)


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95) -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` and ``found array<struct<start,end,kind>>``, a row per input row.

    Counts are of base spans, the digest is of their list, ``spans`` lists all; both are joined by commas
    as kind:start:end, by start and then kind, in code points, end exclusive. A null or
    empty text has none (the digest is of an empty text). Each row is judged by its own text: rows and ids repeat as in the
    input, null ids too; columns besides the two named are ignored. An empty table gives an empty result.
    """
    models = fit(docs.sparkSession, precision)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), let(t, lambda x: spans(x, models)).alias("s"))
    text = lambda own: F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("s", lambda x: x["base"])
    count = lambda k: F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias(id_col), *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("s")).alias("spans"), F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("found"))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", precision: float = 0.95) -> DataFrame:
    """The rows, with all their columns, each span of personal data in the text replaced by its kind; a changed text's length goes to ``length_col``.

    A null text stays null. Nothing is joined, so repeated and null ids make no difference.
    """
    models = fit(docs.sparkSession, precision)
    new = F.when(F.col(text_col).isNotNull(), let(F.col(text_col).cast("string"), lambda t: let(spans(t, models), lambda s: F.when(F.size(s) > 0, redact(t, s)))))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), new.alias("new"))
    own = lambda c: F.col("doc").getField(c)
    change = {text_col: F.coalesce("new", own(text_col))}
    if length_col in docs.columns:
        change[length_col] = F.coalesce(F.length("new").cast(docs.schema[length_col].dataType), own(length_col))
    return packed.select(*[change.get(c, own(c)).alias(c) for c in docs.columns])


def redact(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first is named and all are covered.

    ``found`` is sorted by start.
    """
    covered = running(found, F.lit(0), "int", lambda now, x: F.greatest(now, x["end"].cast("int")))
    piece = lambda a, b: F.substring(text, a + 1, b - a)

    def whole(ends: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(ends, k - 1)).otherwise(0)
        parts = F.transform(found, lambda x, k: F.when(x["start"] >= before(k), F.concat(piece(before(k), x["start"].cast("int")), F.lit("["), x["kind"], F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.lit(2**31 - 1)))

    return F.when(F.size(found) > 0, let(covered, whole)).otherwise(text)
