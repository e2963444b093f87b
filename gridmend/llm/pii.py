"""Personal data: high-recall generators propose spans, boosted trees choose among them by format and context.

The base kinds (e-mail, IP address, card, phone) are matched and checked by rule and always kept. Wider generators
propose further, overlapping spans: number groups, disguised addresses, account numbers. Trees trained on the candidates
of all documents, alike ones counted once with their number as weight, give each a probability. A candidate counts as personal if it is or overlaps a checked base span,
or passes the check of its own kind: an account number its remainder by 97, an address the form of one once its
disguise is undone. What these checks read (sign, remainders, the mark between name and host) is no feature; the trees
see form and context alone. Those above the threshold of their kind, calibrated on held-out rows, are added where they
touch no base span. The trees are applied as column expressions inside each row: one scan to fit, one to choose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm import spans
from gridmend.llm.boosting import Trees, fit
from gridmend.llm.common import saved, text_of

#: Tasks that hold the candidates' distinct descriptions, in an order that is the same in every run.
FIT_TASKS = 16
BASE = ("email", "ip", "card", "phone")
MORE = ("number", "address", "account")
#: Marks stand for a separator between two digits and a dot inside a host name, one character for one, so that the
#: patterns need no repeated groups (which recurse in the matcher and fail on very long runs).
JOIN = "\x01"
EMAIL = "(?:(?<![A-Za-z0-9._%+\\x01-])|\\G)[A-Za-z0-9._%+\\x01-]+@[A-Za-z0-9-]+\\x01[A-Za-z0-9\\x01-]*"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = "[0-9][0-9\\x01]{13,}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![0-9A-Za-z.])\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{2,5}[\x20./-]?[0-9]{2,5}(?:[\x20./-]?[0-9]{2,5}){0,3}(?![0-9A-Za-z])"
ADDRESS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}(?:\x20?[(\[]at[)\]]\x20?|@\x20|\x20@)[A-Za-z0-9-]{2,64}(?:(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z0-9-]{2,64}){0,4}(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z]{2,12}"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KEYWORDS = r"(?i)(tel|phone|fax|mobil|mail|contact|card|visa|iban|account|konto|ssn|passport)"
PLAIN = r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[a-z]{2,6}$"
FEATURES = ("length", "digits", "share", "separators", "groups", "upper", "lower", "dots", "before", "after", "keyword", "colon", "first")


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def account_ok(m: Column) -> Column:
    """Whether an account number leaves 1 by 97: its first four characters last, a letter as two digits (A: 10)."""
    plain = F.regexp_replace(m, " ", "")
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - F.ascii(F.lit("0"))).otherwise(F.ascii(c) - F.ascii(F.lit("A")) + 10)
    turned = F.filter(F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), ""), lambda c: c != "")
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97) == 1


def address_ok(m: Column) -> Column:
    """Whether a disguised address has the form of one once the disguise is undone."""
    at = F.regexp_replace(m, r"\x20?[(\[]at[)\]]\x20?|\x20?@\x20?", "@")
    return F.regexp_replace(at, r"\x20?[(\[]dot[)\]]\x20?", ".").rlike(PLAIN)


def _card_ok(m: Column, _: Column) -> Column:
    d = digits_of(m)
    return F.length(d).between(14, 19) & luhn(d)


def _ip_ok(m: Column, _: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


def _phone_ok(m: Column, _: Column) -> Column:
    return F.length(digits_of(m)).between(10, 15)


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, t and the spans of every kind: base kinds checked (``s_email`` ...), wider kinds as proposed."""
    t = docs.select("doc_id", F.translate(text_of(), "\x01\x02", "\x03\x03").alias("t"))
    hosts = F.regexp_replace("t", "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", JOIN)
    runs = F.regexp_replace("t", "(?<=[0-9])[\\x20-](?=[0-9])", JOIN)
    marked = t.select("doc_id", "t", F.when(F.contains("t", F.lit("@")), hosts).otherwise("").alias("hosts"),
                      F.when(F.col("t").rlike("[0-9](?:[\\x20-]?[0-9]){13}"), runs).otherwise("").alias("runs"))
    gates = {"email": F.contains("hosts", F.lit("@")), "ip": F.col("t").rlike(IP), "card": F.col("runs") != "", "phone": F.contains("t", F.lit("+")) & F.col("t").rlike(PHONE),
             "number": F.col("t").rlike(NUMBER), "address": F.contains("t", F.lit("@")) | F.contains("t", F.lit("at)")) | F.contains("t", F.lit("at]")), "account": F.col("t").rlike(ACCOUNT)}
    plan = (("email", "hosts", EMAIL, None), ("ip", "t", IP, _ip_ok), ("card", "runs", CARD, _card_ok), ("phone", "t", PHONE, _phone_ok),
            ("number", "t", NUMBER, None), ("address", "t", ADDRESS, None), ("account", "t", ACCOUNT, None))
    found = [F.when(gates[k], spans.matches(F.col(c), p, k, i, keep)).otherwise(spans.none()).alias(f"s_{k}") for i, (k, c, p, keep) in enumerate(plan)]
    return marked.select("doc_id", "t", *found)


def overlaps(x: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"]))


def described(found: DataFrame) -> DataFrame:
    """Add ``cands`` and ``sure``, the proposed and the base spans with features, ``touches`` (a base span) and ``label``."""
    base = found.withColumn("base", F.sort_array(F.concat(*[F.col(f"s_{k}") for k in BASE])))
    spanned = base.withColumn("wide", F.sort_array(F.concat(*[F.col(f"s_{k}") for k in MORE])))

    def features(x: Column) -> Column:
        m = F.substr(F.col("t"), x["start"] + 1, x["end"] - x["start"])
        head = F.greatest(F.lit(0), x["start"] - 24)
        ahead, behind = F.substr(F.col("t"), head + 1, x["start"] - head), F.substr(F.col("t"), x["end"] + 1, F.lit(1))
        d = digits_of(m)
        one = lambda c: F.when(c, 1.0).otherwise(0.0)
        count = lambda others: F.length(F.regexp_replace(m, others, "")).cast("double")
        touches = overlaps(x, F.col("base"))
        personal = touches | F.when(x["kind"] == "account", account_ok(m)).when(x["kind"] == "address", address_ok(m)).otherwise(False)
        return F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind"),
                        F.length(m).cast("double").alias("length"), F.length(d).cast("double").alias("digits"), (F.length(d) / F.length(m)).alias("share"),
                        count("[^ ./()-]").alias("separators"), F.size(F.split(m, "[^0-9]+")).cast("double").alias("groups"),
                        count("[^A-Z]").alias("upper"), count("[^a-z]").alias("lower"), count("[^.]").alias("dots"),
                        one(ahead.rlike("[A-Za-z0-9]$")).alias("before"), one(behind.rlike("^[A-Za-z0-9]")).alias("after"), one(ahead.rlike(KEYWORDS)).alias("keyword"),
                        one(ahead.rlike("[:=]\\x20?$")).alias("colon"), F.coalesce(F.left(d, F.lit(1)).try_cast("double"), F.lit(-1.0)).alias("first"),
                        touches.alias("touches"), personal.cast("int").alias("label"))

    return spanned.withColumn("cands", F.transform("wide", features)).withColumn("sure", F.transform("base", features))


def counted(docs: DataFrame) -> DataFrame:
    """The candidates of all documents by description: features, kind, label, held_out (every fifth document) and their number ``n``."""
    rows = described(proposals(docs.select("doc_id", "text"))).select("doc_id", F.explode(F.concat("cands", "sure")).alias("c")).select("doc_id", "c.*")
    key = [*FEATURES, "kind", "label", "held_out"]
    rows = rows.withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).repartition(FIT_TASKS, *key).sortWithinPartitions(*key)


def train(docs: DataFrame) -> Trees:
    """Trees over the candidates of all documents; every fifth document is held out."""
    return fit(saved(counted(docs)), FEATURES, by="kind", weight="n")


def personal_data(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_more and all spans as text.

    Null text counts as empty; null ids and repeated rows come back as they are; an empty table gives no rows, and a
    table without candidates of both labels gets the base spans alone. Only doc_id and text are read.
    """
    trees = train(docs) if trees is None else trees
    found = described(proposals(docs))
    more = F.filter("cands", lambda x: ~x["touches"] & trees.positive({f: x[f] for f in FEATURES}, x["kind"]))
    chosen = found.withColumn("more", F.transform(more, lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind"))).cast(spans.SPAN))
    return chosen.select("doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(spans.joined([F.col("base")]), 256).alias("base_sha256"),
                         F.size("more").cast("long").alias("n_more"), spans.joined([F.col("base"), F.col("more")]).alias("spans"))
