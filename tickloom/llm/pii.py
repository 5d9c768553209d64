"""Personal data: overlapping candidates, boosted trees on format and context, calibrated thresholds.

Labels come from items planted in copies of pieces of the documents, with look-alikes, so the trees learn what a form and its
surroundings say, not a rule.  Everything is DataFrame and SQL functions; a document is one row all the way, nothing is exploded or
shuffled when scoring.  Positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Secrets (keys, tokens, passwords) have no base pattern; all of them come from candidates.
ALL = (*KINDS, "secret")

#: The base patterns.  Runs are possessive and start at the run's start or where the last match ended
#: (\G), which finds the same matches as the plain patterns but in linear time on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of high recall; their spans may overlap those of other kinds.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|[(\[{] ?at ?[)\]}]) ?[A-Za-z0-9-]++(?:(?:\.| \. | ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9A-Za-z.:]))(?:[0-9]++(?:\.[0-9]++){2,7}+|(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+)",
    "card": r"[0-9](?:[\x20./_-]?[0-9]){11,}+",
    "phone": r"(?:\G|(?<![0-9]))[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}",
}
_SECRET_WORD = r"(?i)(?:token|secret|passw(?:or)?d|pwd|(?:api|access|private)[ _-]?key|bearer|credential)s?[\"']?\s*[:=]?\s*[\"']?$"
FEATURES = ("kind", "length", "digits", "groups", "longest", "marks", "first", "variety", "before", "after", "word", "check")
_WORDS = (r"(?i)(?:tel|phone|call|mobile|cell|fax)\W*$", r"(?i)(?:card|visa|credit|account|acct|iban)\W*$", r"(?i)(?:mail|contact|write|send)\W*$", r"(?i)(?:ip|host|server|address|addr)\W*$", _SECRET_WORD)


def prefix_sums(lengths: Column, chunk: int = 128) -> Column:
    """The sum of all earlier elements for each element; in chunks, so that long arrays aren't copied at each step."""

    def scan(part: Column, base: Column) -> Column:
        start = F.struct(base.cast("int").alias("s"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["s"] + x).cast("int").alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")), lambda a: a["out"])

    n = F.ceil(F.size(lengths) / chunk).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(lengths, i * chunk + 1, chunk))
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: (a + x).cast("int")))
    return F.flatten(F.zip_with(parts, scan(sums, F.lit(0)), scan))


def _spans(df: DataFrame, pattern: str, name: str, needed: Column) -> DataFrame:
    """Add the array `name` of all matches in order: struct(s, e, m), starts and exclusive ends in code points."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    df = df.withColumn("_m", F.when(needed, found))
    some = F.size("_m") > 0  # size of null is -1
    df = df.withColumn("_g", F.when(some, F.split("text", pattern, -1)))
    lengths = F.zip_with("_g", "_m", lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    df = df.withColumn("_len", F.when(some, lengths))  # a column: a chunk looks at its part, and doesn't make all of them again
    df = df.withColumn("_at", F.when(some, prefix_sums(F.col("_len"))))
    triples = F.transform("_m", lambda m, i: F.struct((F.get("_at", i) + F.length(F.get("_g", i))).alias("s"), (F.get("_at", i) + F.length(F.get("_g", i)) + F.length(m)).alias("e"), m.alias("m")))
    return df.withColumn(name, F.when(some, triples).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))).drop("_m", "_g", "_at", "_len")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _byte(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _byte),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def _before(x: Column) -> Column:
    """Up to 24 characters before the candidate."""
    return F.when(x["s"] > 0, F.substring(F.col("text"), F.greatest(F.lit(1), x["s"] - 23), F.least(F.lit(24), x["s"]))).otherwise("")


def _email(m: Column) -> Column:
    dots = F.regexp_replace(m, r" ?[(\[{] ?dot ?[)\]}] ?| \. ", ".")
    return F.regexp_replace(dots, r" ?(?:@|[(\[{] ?at ?[)\]}]) ?", "@").rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")


#: A check of a candidate's own characters, whatever stands around it: a feature like others.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": _email,
    "ip": lambda m: F.when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), F.forall(F.split(m, r"\."), _byte)).otherwise(m.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")),
    "card": lambda m: F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m)) & (F.length(F.regexp_replace(_digits(m), "^0+", "")) > 0),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 8),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def with_base(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, the columns in `more`, and an array of base spans for each kind."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)
    needed = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for kind in KINDS:
        df = _spans(df, BASE[kind], f"raw_{kind}", needed.get(kind, F.col("text").rlike("[0-9]")))
        df = df.withColumn(kind, F.filter(f"raw_{kind}", lambda x: VALID[kind](x["m"]))).drop(f"raw_{kind}")
    return df


def _class(c: Column) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike(r"[0-9]"), 3).otherwise(4)


def _features(kind: str, x: Column) -> dict[str, Column]:
    """Whole numbers within small bounds, of format and context."""
    m, d = x["m"], _digits(x["m"])
    runs = F.filter(F.split(m, r"[^0-9A-Za-z]+"), lambda r: F.length(r) > 0)
    before = _before(x)
    near = F.right(before, F.lit(1))
    after = F.substring(F.col("text"), x["e"] + 1, F.lit(1))
    word = F.lit(0)
    for i, w in enumerate(_WORDS):
        word = F.when(before.rlike(w), i + 1).otherwise(word)
    return {
        "kind": F.lit(ALL.index(kind)),
        "length": F.least(F.length(m), F.lit(40)),
        "digits": F.least(F.length(d), F.lit(24)),
        "groups": F.least(F.size(runs), F.lit(8)),
        "longest": F.least(F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), F.lit(24)),
        "marks": F.least(F.length(F.regexp_replace(m, "[0-9A-Za-z ]", "")), F.lit(6)),
        "first": F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(10)),
        "variety": F.size(F.array_distinct(F.split(d, ""))),
        "before": _class(near),
        "after": _class(after),
        "word": word,
        "check": F.coalesce(CHECKS[kind](m), F.lit(False)),
    }


def _needed(kind: str) -> Column:
    """A test that every text with wide candidates of the kind passes."""
    some = {"email": F.contains("text", F.lit("@")) | F.col("text").rlike(r"[(\[{] ?at ?[)\]}]"), "ip": F.col("text").rlike(r"[0-9A-Fa-f][.:][0-9A-Fa-f]"), "secret": F.col("text").rlike("[A-Za-z0-9_+/-]{16}")}
    return some.get(kind, F.col("text").rlike("[0-9]"))


def with_candidates(based: DataFrame) -> DataFrame:
    """Add wide_<kind>: struct(s, e, m, f: features, base: it overlaps a base span of its kind)."""
    df = based
    for kind in ALL:
        df = _spans(df, WIDE[kind], "_wide", _needed(kind))

        def enrich(x: Column) -> Column:
            fs = F.struct(*(c.cast("int").alias(n) for n, c in _features(kind, x).items()))
            base = F.exists(kind, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])) if kind in KINDS else F.lit(False)
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), fs.alias("f"), base.alias("base"))

        df = df.withColumn(f"wide_{kind}", F.transform("_wide", enrich)).drop("_wide")
    return df


class Trees:
    """Boosted trees as nested CASE expressions, and a threshold for each kind."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, f: Column) -> Column:
        def tree(node: object) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, cut, low, high = node
            return F.when(f[name] <= cut, tree(low)).otherwise(tree(high))

        margin = sum((w * tree(t) for w, t in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def _parse(debug: str) -> list[object]:
    """The trees of toDebugString: (feature, cut, at most, above) or a leaf's float."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in debug.splitlines() if re.match(r"\s*(If|Else|Predict|Tree)", x)]
    out, at = [], 0

    def node() -> object:
        nonlocal at
        text = lines[at][1]
        if text.startswith("Predict:"):
            at += 1
            return float(text.split(":")[1])
        m = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", text)
        at += 1
        low = node()
        at += 1  # the Else line
        return FEATURES[int(m[1])], float(m[2]), low, node()

    while at < len(lines):
        if lines[at][1].startswith("Tree"):
            at += 1
            out.append(node())
        else:
            at += 1
    return out


def _drawn(i: int, n: int) -> Column:
    """A number below n that follows from the row."""
    return F.pmod(F.xxhash64("_h", F.lit(i)), F.lit(n))


def _number(i: int, digits: int) -> Column:
    return F.lpad(_drawn(i, 10**digits).cast("string"), digits, "0")


def _one_of(i: int, *options: str | Column) -> Column:
    return F.element_at(F.array(*(F.lit(o) if isinstance(o, str) else o for o in options)), (_drawn(i, len(options)) + 1).cast("int"))


def _luhn(head: Column, digits: int, wrong: int = 0) -> Column:
    """The number with its last digit, or one that is off by `wrong`."""
    double = lambda i: F.substring(head, i + 1, F.lit(1)).cast("int") * F.when((digits - 1 - i) % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(digits - 1)), F.lit(0), lambda a, i: a + F.floor(double(i) / 10).cast("int") + double(i) % 10)
    return F.concat(head, F.pmod(-total + wrong, F.lit(10)).cast("string"))


def _grouped(d: Column, mark: Column, *sizes: int) -> Column:
    cuts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
    return F.concat_ws("", *(x for c, n in zip(cuts, sizes, strict=True) for x in ((mark,) * (c > 1) + (F.substring(d, c, n),))))


def _forms() -> list[tuple[str, int, Column, Column]]:
    """What is planted: kind, whether it is personal data, what leads to it, and the item.

    Every form of personal data has a look-alike that isn't: failing check digits, versions, times, hardware addresses, order and part
    numbers, hashes.  The words around an item are left out for a part of the rows.
    """
    word = _one_of(1, "user", "sales", "j.smith", "anna", "info", "max-m", "k_lee")
    host = F.concat(_one_of(2, "host", "mail", "example", "corp-x", "uni"), _drawn(3, 90).cast("string"))
    end = _one_of(4, "org", "com", "net", "de", "info")
    plain = _one_of(5, "so ", "and ", "with ", "see ", "")
    hex_ = lambda i, n: F.substring(F.sha2(F.concat(F.col("_h").cast("string"), F.lit(str(i))), 256), 1, n)
    ipv6 = F.concat_ws(":", *(F.ltrim(hex_(20 + i, 4), F.lit("0")) for i in range(7)), F.concat(F.lit("a"), hex_(28, 3)))
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("_h").cast("string"), 256))), "[^A-Za-z0-9]", "x")
    token = _one_of(6, hex_(7, 40), hex_(8, 32), F.substring(mixed, 1, 24), F.substring(mixed, 3, 36))
    mark = _one_of(9, ".", "/", "_")
    head = F.concat(_one_of(10, "4", "5", "37"), _number(11, 15))
    said = lambda *words: _one_of(12, *words, *words, *words, plain)
    called = _one_of(13, "phone: ", "tel ", "call ", "mobile ", "cell: ", "fax ")
    counted = _one_of(14, "order ", "item ", "part ", "page ", "room ", "in ", "id ")
    local = _one_of(15, F.concat_ws("-", _number(16, 3), _number(17, 4), _number(18, 3)), F.concat_ws(" ", _number(16, 3), _number(17, 7)), F.concat_ws("/", _number(16, 4), _number(17, 6)), _number(18, 10), F.concat_ws(" ", F.concat(F.lit("0"), _number(16, 2)), _number(17, 3), _number(18, 4)))
    area = F.concat((_drawn(19, 8) + 2).cast("string"), _number(16, 2))
    national = _one_of(17, F.concat(F.lit("("), area, F.lit(") "), _number(18, 3), F.lit("-"), _number(19, 4)), F.concat_ws(".", area, _number(18, 3), _number(19, 4)), F.concat_ws("-", area, _number(18, 3), _number(19, 4)))
    return [
        ("email", 1, said("mail ", "contact ", "write "), F.concat(word, F.lit(" (at) "), host, F.lit(" (dot) "), end)),
        ("email", 1, said("mail ", "contact ", "write "), F.concat(word, F.lit("[at]"), host, F.lit("[dot]"), end)),
        ("email", 1, said("mail ", "contact ", "write "), F.concat(word, F.lit(" @ "), host, F.lit("."), end)),
        ("email", 0, said("mail ", "write "), F.concat(word, _one_of(16, " (at) ", " [at] ", "@"), _one_of(17, "noon", "home", "localhost", host))),
        ("email", 0, plain, F.concat(word, F.lit(" (at) "), _number(16, 2), F.lit("."), _number(17, 2))),
        ("ip", 1, said("host ", "server ", "ip "), ipv6),
        ("ip", 0, said("host ", "server ", "ip "), _one_of(16, F.concat_ws(":", _number(17, 2), _number(18, 2), _number(19, 2), hex_(1, 2)), F.concat_ws(":", *(hex_(30 + i, 2) for i in range(6))))),
        ("ip", 0, plain, F.concat_ws(".", (_drawn(16, 9)).cast("string"), _number(17, 2), (_drawn(18, 30)).cast("string"))),
        ("ip", 0, plain, F.concat_ws(".", (_drawn(16, 600) + 256).cast("string"), _number(17, 2), _number(18, 3), _number(19, 2), F.lit("7"))),
        ("card", 1, said("card ", "visa ", "credit "), _grouped(_luhn(F.substring(head, 1, 15), 15), mark, 4, 4, 4, 4)),
        ("card", 1, said("card ", "account "), _luhn(F.substring(head, 1, 14), 14)),
        ("card", 0, said("card ", "visa ", "credit "), _grouped(_luhn(F.substring(head, 1, 15), 15, 3), mark, 4, 4, 4, 4)),
        ("card", 0, counted, _luhn(F.substring(head, 1, 14), 14, 7)),
        ("phone", 1, called, local), ("phone", 1, said("phone: ", "tel ", "call "), national),
        ("phone", 0, counted, local), ("phone", 0, plain, F.concat_ws("-", F.concat(F.lit("20"), _number(16, 2)), _number(17, 2), F.concat(_number(18, 2), F.lit(" "), _number(19, 2)))),
        ("phone", 0, _one_of(18, called, counted), _number(16, 7)),
        ("secret", 1, _one_of(13, 'token = "', "api_key=", "password: ", "secret ", "Bearer ", "access key: "), token),
        ("secret", 0, _one_of(13, "commit ", "file ", "sha ", "id ", "page ", "see "), token),
        ("secret", 0, _one_of(13, 'token = "', "secret ", "see "), _one_of(16, "configurationmanager", "internationalization", "________________", "----------------")),
    ]


def planted(docs: DataFrame, rows: int, seed: int = 6) -> DataFrame:
    """About `rows` short pieces of the documents, of at most as many documents picked by a hash, each with one item of _forms in it: doc_id,
    text, held (a fifth of the documents), kind, truth, ps and pe (where the item is)."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    n = texts.count()
    each = min(max(1, -(-rows // max(1, n))), rows)
    chosen = texts.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, rows / max(1, n)) * (1 << 30)))
    base = chosen.select(F.xxhash64("text").alias("doc_id"), "text", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("_r")).withColumn("_h", F.xxhash64("doc_id", "_r", F.lit(seed)))
    forms = _forms()
    form = F.lit(None)
    for i, (kind, label, lead, item) in enumerate(forms):
        form = F.when(_drawn(0, len(forms)) == i, F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), lead.alias("lead"), item.alias("item"))).otherwise(form)
    at = (_drawn(40, 1 << 30) % F.greatest(F.lit(1), F.length("text")) + 1).cast("int")
    piece = base.withColumn("form", form).withColumns({"_a": F.substring("text", at, F.lit(60)), "_b": F.substring("text", at + 60, F.lit(60))})
    lead = F.concat("_a", F.lit(" "), "form.lead")
    text = F.concat(lead, "form.item", _one_of(41, ". ", ", ", " ", '" ', "\n"), "_b")
    return piece.select("doc_id", text.alias("text"), (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0).alias("held"), "form.kind", F.col("form.label").alias("truth"), F.length(lead).alias("ps"), (F.length(lead) + F.length("form.item")).alias("pe"))


def labelled(pieces: DataFrame) -> DataFrame:
    """Candidates at the planted items: held, f, label.  Those of another kind than the item's count as none, as do all that touch a
    look-alike; one that finds less than four fifths of an item of its kind, or goes on so far beyond it, is left out."""
    keep = ("held", "kind", "truth", "ps", "pe")
    wide = with_candidates(with_base(pieces, *keep))
    touches = lambda x: ~x["base"] & (x["s"] < F.col("pe")) & (F.col("ps") < x["e"])
    near = lambda x: 5 * (F.least(x["e"], F.col("pe")) - F.greatest(x["s"], F.col("ps"))) >= 4 * (F.greatest(x["e"], F.col("pe")) - F.least(x["s"], F.col("ps")))

    def part(k: str) -> Column:
        yes = (F.col("kind") == k) & (F.col("truth") == 1)
        found = F.filter(f"wide_{k}", lambda x: touches(x) & (~yes | near(x)))
        return F.transform(found, lambda x: F.struct(x["f"].alias("f"), yes.cast("double").alias("label")))

    return wide.select("held", F.explode(F.concat(*map(part, ALL))).alias("c")).select("held", "c.f", "c.label")


def fit(docs: DataFrame, sample: int = 20_000, precision: float = 0.98, rounds: int = 8, depth: int = 4) -> Trees | None:
    """Learn which candidates are personal data from about `sample` pieces of the documents with items planted in them.

    What an item is follows from how it was made, not from a pattern, and the words that go with it are missing for a part.  Equal feature
    rows are counted before fitting.  A fifth of the documents sets the thresholds: for each kind the lowest
    probability, one half at least, from which the candidates reach the precision; a kind that never does has none.  None without documents.
    """
    if docs.limit(1).count() == 0:
        return None
    counted = labelled(planted(docs, sample)).groupBy("held", "f", "label").agg(F.count("*").cast("double").alias("weight")).select("held", "f.*", "label", "weight").cache()
    try:
        packed = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(counted.where("not held"))
        classes = packed.agg(F.count_distinct("label").alias("n")).first().n
        trees = Trees([], {})
        if classes == 2:
            model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.4, weightCol="weight", seed=7).fit(packed.coalesce(2))
            trees = Trees(list(zip(model.treeWeights, _parse(model.toDebugString), strict=True)), {})
        scored = counted.withColumn("p", F.round(trees.probability(F.struct(*FEATURES)), 2)).groupBy("held", "kind", "p").agg(F.sum(F.col("weight") * F.col("label")).alias("yes"), F.sum("weight").alias("all")).collect()
    finally:
        counted.unpersist()
    for i, kind in enumerate(ALL):
        mine = [r for r in scored if r.kind == i]
        if any(r.yes for r in mine if r.held):
            mine = [r for r in mine if r.held]
        good, seen = 0.0, 0.0
        for p in sorted({r.p for r in mine if r.p >= 0.5}, reverse=True):
            good, seen = good + sum(r.yes for r in mine if r.p == p), seen + sum(r["all"] for r in mine if r.p == p)
            if good and good >= precision * seen:
                trees.thresholds[kind] = p
    return trees


def detect(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, an array of base spans per kind, spans: all of them and what the trees add, as
    struct(kind, s, e), by kind, then start, and secrets, likewise.  An added span is a candidate whose calibrated
    probability reaches the threshold of its kind and that overlaps no base span of any kind.  Repeated rows stay, each by its own text; other columns are ignored."""
    df = with_base(docs)
    chosen = {k: t for k, t in (trees.thresholds if trees else {}).items()}
    if chosen:
        df = with_candidates(df)
    parts = []
    for i, kind in enumerate(ALL):
        label = lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
        found = F.transform(kind, label) if kind in KINDS else F.array().cast("array<struct<kind:int,s:int,e:int>>")
        if kind in chosen:
            free = lambda x: ~F.exists(F.concat(*KINDS), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
            added = F.filter(f"wide_{kind}", lambda x: ~x["base"] & free(x) & (F.round(trees.probability(x["f"]), 2) >= chosen[kind]))
            found = F.concat(found, F.transform(added, label))
        parts.append(found)
    return df.select("doc_id", *KINDS, F.array_sort(F.concat(*parts[: len(KINDS)])).alias("spans"), F.array_sort(parts[-1]).alias("secrets"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ALL)), x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The columns of the query: counts and hash of base spans, all spans as text, secrets as text and the number of all
    that would be redacted.  A null or empty text has none; repeated rows stay and other columns are ignored."""
    found = detect(docs, trees)
    base = F.concat(*(F.transform(k, lambda x: F.struct(F.lit(KINDS.index(k)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS))
    more = (_text(F.col("secrets")).alias("secrets"), (F.size("spans") + F.size("secrets")).cast("long").alias("n_redactions"))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"), *more)


def redact(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    found = detect(docs, trees).select("doc_id", F.array_sort(F.transform(F.concat("spans", "secrets"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))).alias("spans"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        piece = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.element_at(F.array(*map(F.lit, ALL)), x["kind"] + 1), F.lit("]"))
        return F.when(x["s"] < a["at"], a).otherwise(F.struct(x["e"].alias("at"), piece.alias("out")))

    return text.join(found, "doc_id").select("doc_id", F.aggregate("spans", empty, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))).alias("text"))
