"""Canonical form tables derived, row for row, from the benchmark star schema.

One SQL text per table serves both Spark and the checking engine; only a few date functions differ by dialect.
Latin letters are mapped to Arabic ones so that every script-dependent rule meets real work on whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from gridmend.session import prepare

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()

LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPT = "ابأديفغهىجكلمنوةقرستؤخعحئز"


def ar(expr: str) -> str:
    return f"translate(lower({expr}), '{LATIN}', '{SCRIPT}')"


class Spark:
    name = "spark"

    @staticmethod
    def words(key, text, source):
        """(key, pos, w): every word of every text."""
        return f"SELECT {key}, pos, w FROM {source} LATERAL VIEW posexplode(split({text}, ' ')) e AS pos, w"

    @staticmethod
    def add_seconds(ts, n):
        return f"timestampadd(SECOND, {n}, {ts})"

    @staticmethod
    def day(ts, fmt):
        return f"date_format({ts}, '{fmt}')"

    @staticmethod
    def part(field, ts):
        return f"{field}({ts})"

    #: Letters are mapped one by one, so the mapping runs once per part and per customer instead of many times per order line.
    part_table = f"(SELECT p_partkey, p_retailprice, {ar('p_name')} AS p_name_ar, {ar('p_type')} AS p_type_ar FROM part) p"
    customer_table = f"(SELECT c_custkey, {ar('c_mktsegment')} AS c_segment_ar FROM customer) c"
    #: Order lines are dealt by order and then by part, before the part's texts stand in their rows: those are never shuffled here.
    line_tables = f"""(SELECT l.*, c_segment_ar FROM lineitem l JOIN (SELECT o_orderkey, c_segment_ar FROM orders JOIN {customer_table} ON o_custkey = c_custkey) o
              ON l_orderkey = o_orderkey) l JOIN {part_table} ON l_partkey = p_partkey"""
    buyer_tables = ""
    part_name_ar, sign_ar = "p_name_ar", f"{ar("'sign '")} || c_segment_ar"
    name_ar = "p_name_ar || ' ' || p_type_ar || ' ' || c_segment_ar"


class Duck:
    name = "duck"

    @staticmethod
    def words(key, text, source):
        return f"SELECT {key}, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT {key}, string_split({text}, ' ') AS ws FROM {source}) s"

    @staticmethod
    def add_seconds(ts, n):
        return f"({ts} + to_seconds({n}))"

    @staticmethod
    def day(ts, fmt):
        pattern = fmt.replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d")
        return f"strftime({ts}, '{pattern}')"

    @staticmethod
    def part(field, ts):
        return f"{field}({ts})"

    line_tables = "lineitem JOIN part ON l_partkey = p_partkey"
    buyer_tables = "\n         JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
    part_name_ar, sign_ar = ar("p_name"), ar("'sign ' || c_mktsegment")
    name_ar = ar("p_name || ' ' || p_type || ' ' || c_mktsegment")


def s(expr: str) -> str:
    return f"cast({expr} as string)"


def idiv(a: str, b) -> str:
    return f"cast(floor(({a}) / {b}) as bigint)"


def pad(expr: str, n: int) -> str:
    return f"lpad({s(expr)}, {n}, '0')"


_TABLES: dict[str, tuple[list[str], object]] = {}


def _table(name, *deps):
    def register(fn):
        _TABLES[name] = (list(deps), fn)
        return fn
    return register


@_table("jobs")
def _jobs(d):
    created = d.add_seconds("o_orderdate", "(o_orderkey * 37) % 86400")
    return f"""
    SELECT 'j' || {s('o_orderkey')} AS job_id, 'u' || {s('o_custkey')} AS user_id,
           'sheet ' || {s('o_orderkey % 97')} || '.pdf' AS document_name,
           CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing'
                ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'failed' END END AS status,
           {created} AS created_at,
           CASE WHEN o_orderstatus = 'F' THEN {d.add_seconds(created, '60 + (o_orderkey * 11) % 3000')} END AS completed_at,
           cast(o_orderkey % 40 as int) AS row_count,
           cast({idiv('(o_orderkey % 40) * 3 + 1', 2)} as int) AS cost_cents,
           CASE WHEN o_orderstatus <> 'F' THEN 'pending' WHEN o_orderkey % 5 = 0 THEN 'unpaid' ELSE 'paid' END AS payment_status,
           md5({s('o_custkey')} || '-' || {s('o_orderkey % 6')}) AS file_hash,
           o_orderkey AS order_key
    FROM orders"""


@_table("form_rows")
def _form_rows(d):
    seven = pad("(l_partkey * 7919 + l_suppkey * 104729) % 10000000", 7)
    nine = pad("(l_partkey * 15485863 + l_orderkey * 32452843 + l_linenumber) % 1000000000", 9)
    eastern = "'٠١٢٣٤٥٦٧٨٩'"
    y, m, dd = (s(d.part(f, "l_shipdate")) for f in ("year", "month", "day"))
    name_ar = d.name_ar
    return f"""
    SELECT 'j' || {s('l_orderkey')} AS job_id,
           l_partkey * 512 + l_linenumber * 64 + l_suppkey % 64 AS row_idx,
           CASE WHEN l_partkey % 11 = 0 THEN {d.part_name_ar}
                WHEN l_partkey % 11 = 1 THEN replace({name_ar}, 'ي', 'ى')
                WHEN l_partkey % 11 = 2 THEN {name_ar} || ' ' || split_part({name_ar}, ' ', 1)
                WHEN l_partkey % 53 = 3 THEN '05912345' || {s('l_partkey % 10')} || '7'
                ELSE {name_ar} END AS person,
           CASE l_suppkey % 8 WHEN 0 THEN '059' || {seven} WHEN 1 THEN '59' || {seven}
                WHEN 2 THEN '+970 59' || {seven} WHEN 3 THEN '056-' || substr({seven}, 1, 3) || ' ' || substr({seven}, 4, 4)
                WHEN 4 THEN translate('059' || {seven}, '0123456789', {eastern})
                WHEN 5 THEN '259' || {seven} WHEN 6 THEN '0591' ELSE '' END AS phone,
           CASE l_suppkey % 6 WHEN 0 THEN substr({nine}, 1, 6) || ' ' || substr({nine}, 7, 3)
                WHEN 1 THEN substr({nine}, 1, 8) WHEN 2 THEN '960 *** ' || substr({nine}, 7, 3)
                ELSE {nine} END AS idno,
           CASE l_linenumber WHEN 1 THEN {y} || '/' || {m} || '/' || {dd} WHEN 2 THEN {dd} || '/' || {m} || '/' || {y}
                WHEN 3 THEN {m} || '.' || {dd} || '.' || {y} WHEN 4 THEN {d.day('l_shipdate', 'yyyy-MM-dd')}
                WHEN 5 THEN '2.8/' || {m} || '/' || {dd} WHEN 6 THEN {dd} || '-' || {s(d.part('month', 'l_shipdate') + ' % 9 + 1')} || {y}
                ELSE CASE WHEN l_partkey % 3 = 0 THEN 'K' || {y} || '-' || {dd} || ' ' || {m} ELSE {y} END END AS dob,
           CASE l_partkey % 9 WHEN 0 THEN 'ذكر' WHEN 1 THEN 'أنتى' WHEN 2 THEN 'زلر' WHEN 3 THEN 'انثى انثى'
                WHEN 4 THEN '8' WHEN 5 THEN 'male' WHEN 6 THEN 'ذكر ذكر' WHEN 7 THEN '✓' ELSE '' END AS gender,
           CASE l_suppkey % 7 WHEN 0 THEN 'نعم' WHEN 1 THEN 'موافق موافق' WHEN 2 THEN 'لا' WHEN 3 THEN 'x'
                WHEN 4 THEN 'podéis!' WHEN 5 THEN 'غير موافق' ELSE '' END AS approval,
           CASE l_linenumber WHEN 1 THEN 'نعم' WHEN 2 THEN 'لا' WHEN 3 THEN 'كلا' WHEN 4 THEN 'لحم' WHEN 5 THEN '1' ELSE '' END AS disability,
           CASE WHEN l_linenumber % 3 = 0 THEN {name_ar} WHEN l_linenumber % 3 = 1 THEN split_part({name_ar}, ' ', 1)
                ELSE {d.sign_ar} END AS signature,
           {s('p_retailprice')} AS price, {s('cast(l_quantity as bigint)')} AS qty,
           CASE WHEN l_suppkey % 4 = 0 THEN {s('round(p_retailprice * l_quantity + 1, 2)')}
                WHEN l_suppkey % 13 = 1 THEN 'n/a' ELSE {s('round(p_retailprice * l_quantity, 2)')} END AS total,
           {s('l_linenumber')} AS serial, {name_ar} AS clean_name,
           CASE l_suppkey % 6 WHEN 0 THEN substr(phrase, 1, 3) || substr(phrase, 5) WHEN 1 THEN translate(phrase, 'ن', 'ي')
                WHEN 2 THEN phrase || ' ' || {s('l_partkey % 7')} WHEN 3 THEN '' ELSE phrase END AS place,
           l_orderkey AS order_key, l_partkey AS part_key, l_suppkey AS supp_key, l_linenumber AS line_no
    FROM {d.line_tables}
         JOIN (SELECT item_id, {ar("split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)")} AS phrase FROM benchmark) b
              ON l_partkey % (SELECT count(*) FROM benchmark) = b.item_id{d.buyer_tables}"""


# --- fixed values: headers of the stand-in form, in column order -------------------------------------------
FIELDS = [("#", "serial"), ("الاسم الرباعي", "person"), ("رقم الهاتف", "phone"), ("رقم الهوية", "idno"),
          ("تاريخ الميلاد", "dob"), ("الجنس", "gender"), ("الموافقة", "approval"), ("هل لديك إعاقة", "disability"),
          ("العنوان", "place"), ("سعر الوحدة", "price"), ("الكمية", "qty"), ("المجموع", "total"), ("التوقيع", "signature")]
HEADER = {col: head for head, col in FIELDS}
COL_IDX = {col: i for i, (_, col) in enumerate(FIELDS)}


def cells_sql(*cols: str) -> str:
    """Long cells for the named form columns; blank text is null, as at ingest."""
    arms = [f"SELECT job_id, row_idx, '{HEADER[c]}' AS field, cast({COL_IDX[c]} as int) AS col_idx, "
            f"CASE WHEN trim({c}) = '' THEN NULL ELSE {c} END AS value FROM form_rows" for c in cols]
    return "\n UNION ALL ".join(arms)


@_table("places_seed")
def _places_seed(d):
    return f"""
    SELECT DISTINCT {ar("w || ' ' || following")} AS canonical FROM (
        SELECT w, lead(w) OVER (PARTITION BY item_id ORDER BY pos) AS following FROM ({d.words('item_id', 'text', 'benchmark')}) t) p
    WHERE w <> '' AND following <> ''"""


@_table("training")
def _training(d):
    base = "timestamp '2024-03-01 00:00:00'"
    return f"""
    SELECT 't' || {s('l.doc_id')} AS id, 'j' || d.source AS job_id, l.doc_id AS participant_index,
           'الاسم الرباعي' AS field_name,
           {ar("d.text")} AS label,
           CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'approved' WHEN l.quality = 1 THEN 'verified'
                WHEN l.toxic = 1 THEN 'rejected' ELSE 'pending' END AS status,
           {d.add_seconds(base, '(l.doc_id * 7 % 100000) * 20')} AS created_at,
           CASE WHEN l.quality = 1 OR l.toxic = 1 THEN 'u' || {s('l.doc_id % 23')} END AS verified_by,
           CASE WHEN l.quality = 1 OR l.toxic = 1 THEN {d.add_seconds(base, '86400 + (l.doc_id * 13 % 90000) * 25')} END AS verified_at,
           CASE WHEN l.quality = 1 AND l.toxic = 1 AND l.doc_id % 4 <> 0 THEN {d.add_seconds(base, '172800 + (l.doc_id * 17 % 90000) * 25')} END AS reviewed_at,
           'crops/' || {s('l.doc_id')} || '.png' AS crop_path,
           CASE WHEN l.doc_id % 3 <> 0 THEN 'crops/' || {s(idiv('l.doc_id', 2))} || '_ctx.png' END AS context_path,
           l.doc_id AS doc_id, d.lang AS lang
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


@_table("profiles")
def _profiles(d):
    return f"""
    SELECT 'u' || {s('c_custkey')} AS user_id, lower(c_mktsegment) || {s('c_custkey')} || '@example.org' AS email,
           CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE c_name END AS full_name,
           CASE WHEN c_custkey % 8 = 0 THEN 'Meta ' || {s('c_custkey')} END AS meta_name,
           cast(floor(c_acctbal) as bigint) AS balance_cents, c_custkey % 70 AS rows_used_total,
           c_custkey % 9 AS login_count, c_custkey % 50 = 0 AS is_admin,
           {d.add_seconds("timestamp '2001-06-01 00:00:00'", '(c_custkey * 7919 % 5300000)')} AS created_at,
           {d.add_seconds("timestamp '2001-07-01 00:00:00'", '(c_custkey * 104729 % 2700000)')} AS last_active_at,
           c_nationkey AS nation_key
    FROM customer"""


#: What two of the engines read in the name cell of an order line.
READ_NAME = {
    "gemini": """CASE WHEN supp_key % 9 = 0 THEN '' WHEN part_key % 7 = 2 THEN replace(clean_name, 'ا', 'أ')
                WHEN part_key % 7 = 3 THEN translate(clean_name, 'ريل', 'زبا') ELSE clean_name END""",
    "azure": """CASE WHEN supp_key % 10 = 1 THEN '' WHEN part_key % 4 = 1 THEN translate(clean_name, 'سن', 'شي')
                WHEN part_key % 7 = 3 THEN translate(clean_name, 'ري', 'دت') ELSE clean_name END"""}


@_table("readings", "form_rows")
def _readings(d):
    """Three engines reading the same name cell, each with its own key-determined slips."""
    vis = "CASE WHEN part_key % 5 = 0 THEN split_part(clean_name, ' ', 1) || ' ' || split_part(clean_name, ' ', 2) " \
          "WHEN part_key % 5 = 1 THEN translate(clean_name, 'د', 'ذ') ELSE clean_name END"
    return f"""
    SELECT job_id, row_idx, clean_name,
           {READ_NAME["gemini"]} AS gemini,
           {READ_NAME["azure"]} AS azure,
           CASE WHEN supp_key % 11 = 2 THEN '' ELSE {vis} END AS vision,
           person AS current_value, part_key, supp_key
    FROM form_rows"""


@_table("vocab")
def _vocab(d):
    """Known name words: the words of every second product name and of the product types."""
    tok = ar("w")
    return f"""
    SELECT DISTINCT {tok} AS token FROM (
        SELECT split_part(p_name, ' ', 1) AS w FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT split_part(p_name, ' ', 2) AS w FROM part WHERE length(p_name) % 3 <> 0
        UNION ALL SELECT p_type AS w FROM part WHERE p_type <> 'PROMO') v WHERE length(w) >= 2"""


@_table("corrections", "form_rows")
def _corrections(d):
    return f"""
    SELECT 'c' || {s('line_no')} || '-' || job_id || '-' || {s('row_idx')} AS id,
           {d.add_seconds("timestamp '2024-02-01 00:00:00'", '(order_key * 31 + part_key * 7 + line_no) % 2000000')} AS created_at,
           job_id, row_idx, 'الاسم الرباعي' AS field_name, person AS original_value,
           CASE WHEN part_key % 3 = 0 THEN clean_name ELSE clean_name || ' ' || split_part(clean_name, ' ', 2) END AS corrected_value,
           part_key
    FROM form_rows WHERE (part_key + supp_key) % 5 = 0"""


@_table("ledger")
def _ledger(d):
    return f"""
    SELECT 'e' || {s('event_id')} AS id, 'u' || {s('user_id')} AS user_id,
           CASE event_type WHEN 'purchase' THEN 'topup' WHEN 'signup' THEN 'grant' WHEN 'error' THEN 'adjust' ELSE 'charge' END AS kind,
           CASE WHEN event_type IN ('purchase', 'signup') THEN cast(floor(value * 10) as bigint)
                WHEN event_type = 'error' THEN -(event_id % 5) ELSE -cast(floor(value * 3) as bigint) END AS amount_cents,
           CASE WHEN event_type IN ('click', 'view') THEN 'j' || {s('event_id % 4000')} END AS job_id,
           ts AS created_at, event_id
    FROM events"""


@_table("doc_text")
def _doc_text(d):
    """Document text in Arabic script; separators, digits and marks stay as they are."""
    return f"SELECT doc_id, {ar('text')} AS text, lang, source FROM documents"


def _order(names):
    seen, out = set(), []

    def visit(n):
        if n in seen:
            return
        seen.add(n)
        for dep in _TABLES[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def ctes(names, dialect) -> str:
    """``name AS (...)`` items for the named tables and what they build on."""
    kept = " MATERIALIZED" if dialect is Duck else ""
    return ",\n".join(f"{n} AS{kept} ({_TABLES[n][1](dialect)})" for n in _order(names))


_REGISTERED: dict[str, str] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Name the base tables once per application and data folder."""
    prepare(spark)
    # shuffled sides whose every partition is small are hashed, so that only larger ones are sorted on both sides
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    app = spark.sparkContext.applicationId
    if _REGISTERED.get(app) == sf_dir and spark.catalog.tableExists("lineitem"):
        return
    _REGISTERED[app] = sf_dir
    for t in BASE:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def together(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df``, planned so that rows which lie together by some keys of a join or an aggregate are not dealt again by all of them.

    For queries whose rows are dealt by job or page, of which there are many. A page far larger than the others is still
    split by adaptive execution, which then deals it again. Holds until the next table is asked for.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    if name in BASE:
        return spark.table(name)
    return spark.sql(f"WITH {ctes([name], Spark)} SELECT * FROM {name}")


#: Bits below a row number that tell rows of one job and number apart.
COPY_BITS = 24


def own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``form_rows`` with a number of its own for every row: order lines can share job and row number.

    ``row_idx`` is shifted left and counts such rows in its last bits, by values that tell them apart; rows alike in all
    are interchangeable. :func:`row_of` gives the number back.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    same = Window.partitionBy("job_id", "row_idx").orderBy("supp_key", "qty", "dob", "total")
    rows = table(spark, sf_dir, "form_rows")
    return rows.withColumn("copy", F.row_number().over(same) - 1).withColumn("row_idx", F.shiftleft("row_idx", COPY_BITS) + F.col("copy")).drop("copy")


def row_of(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumn("row_idx", F.shiftright("row_idx", COPY_BITS))


def cells(spark: SparkSession, sf_dir: str, *cols: str, rows: DataFrame | None = None) -> DataFrame:
    """Same rows as :func:`cells_sql`, read once and unpivoted; of ``rows`` where given."""
    from pyspark.sql import functions as F

    rows = table(spark, sf_dir, "form_rows") if rows is None else rows
    wide = rows.select("job_id", "row_idx", *[F.when(F.trim(F.col(c)) != "", F.col(c)).alias(HEADER[c]) for c in cols])
    # what no reader asks for is pruned here; an array of structs would be built whole for every row
    long = wide.unpivot(["job_id", "row_idx"], [HEADER[c] for c in cols], "field", "value")
    col_idx = reduce(lambda e, c: e.when(F.col("field") == HEADER[c], F.lit(COL_IDX[c])), cols, F)
    return long.select("job_id", "row_idx", "field", col_idx.cast("int").alias("col_idx"), "value")


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """Checking-engine SQL: the named tables as CTEs, then ``body`` (which may open with more CTEs after a comma)."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    items = ctes(names, Duck) if names else "__one AS (SELECT 1)"
    return f"{head}{items}\n{body}"


def duck_cells(*cols: str) -> str:
    """A ``cells`` CTE for the checking engine, to follow ``form_rows``."""
    return f", cells AS ({cells_sql(*cols)})"
