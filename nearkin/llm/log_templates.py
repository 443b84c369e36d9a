"""Line dedup by a log-template tree, in column expressions and joins only.

Lines are parsed into tokens between blanks; tokens with a digit are variable at
once. The tree has a fixed depth: a line goes down by its number of tokens and
then by its first three. In a leaf, the tokens that most of the leaf's different
lines agree on, place by place, are a template; a line that has at least six
tenths of them after the leading ones is an instance of it, and where it differs
is a variable field. Lines that are none part by the token they share with most of
the others at its place, and each of these groups has a template in the same way;
what is still left parts once more. Any other line is a template of its own. A
template that occurs in three documents or more is boilerplate: its lines go from
all of them but the first.

Only hashes of lines are aggregated and joined. Text is fetched for one line of
each different one in leaves that hold several, and documents are joined with
their own dropped places at the end. A line's copies are pre-aggregated before
they meet, and joins with hot lines have a written table on the other side, so
that they can be split.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm.common import read, unused
from nearkin.sources.storage import MAX_BROADCAST_KEYS, MAX_DRIVER_BYTES, durable

LEADING_TOKENS = 3
MIN_TOKENS = 3
MIN_SHARE = 0.6
MIN_DOCS = 3
#: Lines of fewer tokens count from so many characters on, as scripts without blanks need.
MIN_CHARS = 30
#: How often lines without a template part by a token they share.
PARTINGS = 2
#: Different lines that share the token, at least.
PART_LINES = 3
#: A wanted line takes that many bytes where it is sent out.
_WANTED_BYTES = 40
VARIABLE = "<*>"

_BLANKS = r"[ \t\r\f]+"


def masked_line(line: Column) -> Column:
    """The line with single blanks between tokens and those with digits masked."""
    # most lines need neither expression, and finding that out is cheap
    uneven = reduce(or_, (line.contains(x) for x in ("  ", "\t", "\r", "\f")))
    plain = F.trim(F.when(uneven, F.regexp_replace(line, _BLANKS, " ")).otherwise(line))
    masked = F.regexp_replace(plain, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)
    digits = reduce(or_, (plain.contains(str(x)) for x in range(10)))
    return F.when(digits, masked).otherwise(plain)


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line, with its place in the tree; empty ones have one token.

    Lines that don't count have no hashes. They are for the reader of the written rows to
    leave out: a condition here would mask each line a second time.
    """
    text = F.col(text_col)
    # a text is hashed once and not for each of its lines, which then go without it
    hashed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("dh"), F.split(text, "\n").alias("lines"))
    broken = hashed.select("doc", "dh", F.posexplode("lines").alias("pos", "line"))
    m = masked_line(F.col("line"))
    blanks = F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))
    counts = (blanks + 1 >= MIN_TOKENS) | (F.length(m) >= MIN_CHARS)
    return broken.select(
        "doc",
        "dh",
        "pos",
        (blanks + 1).alias("n"),
        F.when(counts, F.xxhash64(F.substring_index(m, " ", LEADING_TOKENS))).alias("lh"),
        F.when(counts, F.xxhash64(m)).alias("th"),
        counts.alias("counts"),
    )


def _leaf_instances(docs: DataFrame, id_col: str, text_col: str, narrow: DataFrame) -> DataFrame:
    """``(n, lh, th, part)`` of the different lines that are instances of a template.

    ``part`` tells the templates of a leaf apart.
    """
    one = F.min(F.struct("doc", "dh", "pos")).alias("one")
    different = durable(narrow.where(F.col("n") > LEADING_TOKENS).groupBy("n", "lh", "th").agg(one), "lines")
    leaves = different.groupBy("n", "lh").agg(F.count("*").alias("k")).where("k > 1")
    line = F.struct("n", "lh", "th", F.col("one.pos").alias("pos"))
    # no more lines than the document has
    wanted = different.join(leaves, ["n", "lh"]).groupBy("one.doc", "one.dh").agg(
        F.collect_list(line).alias("lines")
    )
    wanted = durable(wanted, "wanted")
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.size("lines")).alias("lines")).first()
    few = size.n <= MAX_BROADCAST_KEYS and _WANTED_BYTES * (size.lines or 0) <= MAX_DRIVER_BYTES
    text = F.col(text_col)
    same = F.col(id_col).eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("dh"))
    met = docs.join(F.broadcast(wanted) if few else wanted, same)
    broken = F.split(text, "\n")
    fetched = met.select(broken.alias("broken"), F.explode("lines").alias("l")).select(
        "l.n", "l.lh", "l.th", masked_line(F.get("broken", F.col("l.pos"))).alias("m")
    )
    fetched = fetched.dropDuplicates(["n", "lh", "th"])
    tokens = F.split("m", " ")
    rest = F.slice(tokens, LEADING_TOKENS + 1, F.size(tokens))
    rows = durable(fetched.select("n", "lh", "th", rest.alias("rest")), "leaf_lines")
    whole = F.lit(0).cast("long").alias("part")
    found = durable(_instances(rows.select("*", whole)), "instances")
    for turn in range(PARTINGS):
        rows = durable(rows.join(found, ["n", "lh", "th"], "left_anti"), "leaf_lines")
        if rows.isEmpty():
            break
        more = durable(_instances(_parted(rows, turn + 1)), "instances")
        found = found.union(more)
    return found


def _parted(rows: DataFrame, turn: int) -> DataFrame:
    """Lines with the ``part`` of the token and place most other lines share with them."""
    leaves = rows.groupBy("n", "lh").agg(F.count("*").alias("k")).where(F.col("k") >= PART_LINES)
    rows = durable(rows.join(leaves.drop("k"), ["n", "lh"]), "leaf_lines")
    places = rows.select("n", "lh", "th", F.posexplode("rest").alias("at", "token"))
    shared = places.groupBy("n", "lh", "at", "token").agg(F.count("*").alias("k"))
    shared = durable(shared.where(F.col("k") >= PART_LINES), "shared")
    most = F.min(F.struct((-F.col("k")).alias("k"), "at", "token")).alias("most")
    anchors = places.join(shared, ["n", "lh", "at", "token"]).groupBy("n", "lh", "th").agg(most)
    part = F.xxhash64(F.lit(turn), "most.at", "most.token").alias("part")
    return rows.join(anchors, ["n", "lh", "th"]).select("n", "lh", "th", "rest", part)


def _instances(rows: DataFrame) -> DataFrame:
    """``(n, lh, th, part)``: the lines that agree with most others of their part."""
    counted = (
        rows.select("n", "lh", "part", F.posexplode("rest").alias("at", "token"))
        .groupBy("n", "lh", "part", "at", "token")
        .agg(F.count("*").alias("k"))
    )
    top = counted.groupBy("n", "lh", "part", "at").agg(
        F.min(F.struct((-F.col("k")).alias("k"), "token"))["token"].alias("token")
    )
    # as long as the line itself
    ordered = F.array_sort(F.collect_list(F.struct("at", "token")))
    template = top.groupBy("n", "lh", "part").agg(F.transform(ordered, lambda s: s["token"]).alias("top"))
    agree = F.size(F.filter(F.zip_with("rest", "top", lambda a, b: a == b), lambda x: x))
    enough = agree >= F.lit(MIN_SHARE) * F.size("rest")
    return rows.join(template, ["n", "lh", "part"]).where(enough).select("n", "lh", "th", "part")


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``(doc, dh, dropped)``: places of the lines that go, for documents that lose some.

    A document is an id with a text's hash, so rows alike in both are one.
    """
    docs = docs.select(id_col, text_col)
    narrow = durable(_places(docs, id_col, text_col), "places").where("counts").drop("counts")
    instances = _leaf_instances(docs, id_col, text_col, narrow)
    # an instance stands for its template, any other line for itself
    own = F.when(F.col("part").isNull(), F.col("th")).alias("t")
    placed = narrow.join(instances, ["n", "lh", "th"], "left").select(
        "doc", "dh", "pos", "n", "lh", "part", own
    )
    placed = durable(placed, "placed")
    owner = F.struct("doc", "dh")
    found = placed.groupBy("n", "lh", "part", "t", "doc", "dh").agg(F.lit(1).alias("x"))
    recurring = found.groupBy("n", "lh", "part", "t").agg(
        F.count("*").alias("docs"), F.min(owner).alias("first")
    )
    recurring = durable(
        recurring.where(F.col("docs") >= min_docs).select(
            F.col("n").alias("rn"),
            F.col("lh").alias("rl"),
            F.col("part").alias("rp"),
            F.col("t").alias("rt"),
            "first",
        ),
        "recurring",
    )
    same = (
        (F.col("n") == F.col("rn"))
        & (F.col("lh") == F.col("rl"))
        & F.col("part").eqNullSafe(F.col("rp"))
        & F.col("t").eqNullSafe(F.col("rt"))
    )
    later = ~owner.eqNullSafe(F.col("first"))
    gone = placed.join(recurring, same).where(later)
    return gone.groupBy("doc", "dh").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_docs: int = MIN_DOCS,
    counts: bool = True,
) -> DataFrame:
    """All columns of ``docs``, the text without its boilerplate, and two counts.

    With ``counts``, ``n_lines`` and ``n_dropped`` are added (and replace columns of that
    name). Lines end at newlines; a line of fewer than three tokens and thirty
    characters is never dropped, nor is any line of the first document that has its
    template, first by id and then by hash of the text, a null id before all. A null
    text stays null and has no lines, an empty one has one. A document may lose all its
    lines and keeps its row with an empty text.
    """
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    gone = dropped_lines(docs, id_col, text_col, min_docs=min_docs)
    owner, lost = unused(docs, "owner"), unused(docs, "lost")
    gone = gone.select(F.struct("doc", "dh").alias(owner), F.col("dropped").alias(lost))
    text = F.col(text_col)
    same = F.col(id_col).eqNullSafe(F.col(f"{owner}.doc")) & (F.xxhash64(text) == F.col(f"{owner}.dh"))
    joined = docs.join(gone, same, "left")
    lines = F.split(text, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    new = F.when(F.col(lost).isNull(), text).otherwise(kept)
    columns = [new.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if not counts:
        return joined.select(*columns)
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return joined.select(
        *columns,
        F.coalesce(newlines + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


# The lines of one turn, their part, its template, and those that are instances of it.
_TURN_SQL = """, counted{i} AS (
  SELECT n, lead, part, pos, token, count(*) AS k FROM (
    SELECT n, lead, part, unnest(rest) AS token, unnest(range(len(rest))) AS pos FROM lines{i}
  ) GROUP BY ALL
), tops{i} AS (
  SELECT n, lead, part, pos, min(struct_pack(k := -k, token := token)).token AS token
  FROM counted{i} GROUP BY ALL
), templates{i} AS (
  SELECT n, lead, part, list(token ORDER BY pos) AS top FROM tops{i} GROUP BY ALL
), instances{i} AS (
  SELECT s.n, s.lead, s.m, s.part FROM lines{i} s
  JOIN templates{i} t ON s.n = t.n AND s.lead = t.lead AND s.part = t.part
  WHERE len(list_filter(range(1, len(rest) + 1), lambda i: rest[i] = top[i])) >= 0.6 * len(rest)
)"""
_PARTED_SQL = """, left{i} AS (
  SELECT * FROM lines{before} l
  WHERE NOT EXISTS (SELECT 1 FROM instances{before} f WHERE f.n = l.n AND f.lead = l.lead AND f.m = l.m)
), places{i} AS (
  SELECT n, lead, m, unnest(rest) AS token, unnest(range(len(rest))) AS pos FROM left{i}
), shared{i} AS (
  SELECT n, lead, pos, token, count(*) AS k FROM places{i} GROUP BY ALL HAVING count(*) >= {part_lines}
), anchors{i} AS (
  SELECT n, lead, m, min(struct_pack(k := -k, pos := pos, token := token)) AS most
  FROM places{i} JOIN shared{i} USING (n, lead, pos, token) GROUP BY n, lead, m
), lines{i} AS (
  SELECT n, lead, m, rest, concat_ws(' ', {i}, most.pos, most.token) AS part
  FROM left{i} JOIN anchors{i} USING (n, lead, m)
)"""

OP3_SQL = r"""
WITH broken AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
), toks AS (
  SELECT doc_id, text, pos, list_transform(string_split(plain, ' '),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tk
  FROM (SELECT *, trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g'), ' ') AS plain FROM broken)
  WHERE plain <> ''
), lines AS (
  SELECT doc_id, text, pos, tk, len(tk) AS n, array_to_string(tk[1:3], ' ') AS lead,
    array_to_string(tk, ' ') AS m
  FROM toks WHERE len(tk) >= 3 OR length(array_to_string(tk, ' ')) >= 30
), different AS (
  SELECT DISTINCT n, lead, m, tk[4:] AS rest FROM lines WHERE n > 3
), lines0 AS (
  SELECT *, 'leaf' AS part FROM different QUALIFY count(*) OVER (PARTITION BY n, lead) > 1
)""" + "".join(
    (_PARTED_SQL.format(i=i, before=i - 1, part_lines=PART_LINES) if i else "") + _TURN_SQL.format(i=i)
    for i in range(PARTINGS + 1)
) + ", instances AS (" + " UNION ALL ".join(
    f"SELECT * FROM instances{i}" for i in range(PARTINGS + 1)
) + r"""
), placed AS (
  SELECT l.doc_id, l.text, l.pos, l.n, l.lead, i.part, CASE WHEN i.m IS NULL THEN l.m END AS t
  FROM lines l LEFT JOIN instances i ON l.n = i.n AND l.lead = i.lead AND l.m = i.m
), recurring AS (
  SELECT n, lead, part, t, min(doc_id) AS first_doc FROM placed
  GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3
), gone AS (
  SELECT p.doc_id, p.pos FROM placed p JOIN recurring r
    ON p.n = r.n AND p.lead = r.lead
    AND p.part IS NOT DISTINCT FROM r.part AND p.t IS NOT DISTINCT FROM r.t
  WHERE p.doc_id <> r.first_doc
)
SELECT b.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
  md5(coalesce(string_agg(CASE WHEN g.pos IS NULL THEN b.line END, chr(10) ORDER BY b.pos), '')) AS kept_md5
FROM broken b LEFT JOIN gone g ON b.doc_id = g.doc_id AND b.pos = g.pos
GROUP BY b.doc_id
"""
