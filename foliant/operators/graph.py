"""Entities, relations and traversal over two tables: vertices and edges."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import staged

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: What marks an organisation, a department, and words that no person's name holds.
ORG_ENDINGS = "Inc|Corp|Corporation|Ltd|LLC|GmbH|Company|Technologies|Solutions|Systems|Group|Holdings|Partners|Bank|University|Institute|Labs"
DEPARTMENTS = {
    "hr": "HR", "human resources": "Human Resources", "finance": "Finance", "legal": "Legal", "engineering": "Engineering", "operations": "Operations",
    "marketing": "Marketing", "sales": "Sales", "it": "IT", "research": "Research", "accounting": "Accounting",
}
NAME_STOP = (
    "January February March April May June July August September October November "
    "December Monday Tuesday Wednesday Thursday Friday Saturday Sunday The This "
    "New York Annual Leave Policy Employee Handbook Total Page Report Quarterly"
).split()
#: Entity patterns in order of precedence; the group is what is kept.
ENTITY_PATTERNS = (
    ("email", re.compile(r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"), 0),
    ("money", re.compile(r"(?:[$€£]\s?\d[\d,]*(?:\.\d{1,2})?)|(?:\b\d[\d,]*(?:\.\d{1,2})?\s?(?:USD|EUR|GBP|PKR)\b)"), 0),
    ("date", re.compile(rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}}\b|\b\d{{1,2}}\s+(?:{MONTHS})[a-z]*\s+\d{{4}}\b|\b(?:{MONTHS})[a-z]*\s+\d{{1,2}},?\s+\d{{4}}\b", re.I), 0),
    ("organization", re.compile(rf"\b(?:[A-Z][\w&.-]*\s)+(?:{ORG_ENDINGS})\.?\b"), 0),
    ("person", re.compile(r"\b(?:Mr|Ms|Mrs|Dr|Prof)\.?\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+){1,2})\b"), 1),
    ("person", re.compile(r"\b([A-Z][a-z]{2,})\s([A-Z][a-z]{2,})\b"), 0),
    ("department", re.compile(rf"\b({'|'.join(map(re.escape, DEPARTMENTS))})\b(?:\s+department)?", re.I), 1),
)
_SPACE, _DIGIT = r"[\s\x0b\x1c-\x1f\x85\p{Z}]", r"[0-9\x{80}-\x{10ffff}]"
_LONGER = "|".join(d.replace("i", "[i\u0131\u0130]") for d in DEPARTMENTS if len(d) > 2)
#: What a text must hold for each of these patterns to find something, for Arrow's regular expressions (linear, on bytes).
#: They ask for less, never for more: where Unicode tables may differ, any character beyond ASCII will do.
ENTITY_SIGNS = (
    r"@\S+\.",
    rf"[$€£]{_SPACE}?{_DIGIT}|(?:{_DIGIT}|,){_SPACE}?(?:USD|EUR|GBP|PKR)",
    rf"{_DIGIT}{{4}}-{_DIGIT}{{2}}-{_DIGIT}{{2}}|{_DIGIT}{{1,2}}[/.]{_DIGIT}{{1,2}}[/.]{_DIGIT}{{2}}|(?:^|[^a-zA-Z])(?i:{MONTHS})[a-zA-Z\x{{80}}-\x{{10ffff}}]*{_SPACE}+{_DIGIT}",
    rf"[A-Z]\S*{_SPACE}(?:{ORG_ENDINGS})",
    rf"(?:Mr|Ms|Mrs|Dr|Prof)\.?{_SPACE}+[A-Z][a-z]",
    rf"[A-Z][a-z]{{2,}}{_SPACE}[A-Z][a-z]{{2}}",
    rf"(?i:{_LONGER})|HR|[I\x{{130}}]T",
)
#: Letters that a pattern takes for i and s, case aside; a dotted capital I is lower-cased to an i and a dot.
_ODD_LETTERS = {0x131: "i", 0x17F: "s", 0x307: None}
#: With ``compat`` two letters name a department in any case.
_SHORTER = r"(?i:hr|[i\x{131}\x{130}]t)"
#: Fixed values: (cue between two mentions, relation, type before, type after), first match wins.
CUES = (
    (r"(?i)\breports?\s+to\b", "REPORTS_TO", "person", "person"),
    (r"(?i)\b(?:works?|working)\s+(?:in|for|at)\b|\bjoined\b|\bmember\s+of\b", "WORKS_IN", "person", "department"),
    (r"(?i)\b(?:works?|working)\s+(?:for|at)\b|\bjoined\b|\bemployed\s+by\b", "EMPLOYED_BY", "person", "organization"),
    (r"(?i)\b(?:heads?|leads?|manages?|head\s+of)\b", "MANAGES", "person", "department"),
    (r"(?i)\bsigned\b|\bapproved\b|\bauthorized\b", "APPROVED", "person", "money"),
)
#: Type pairs, in alphabetical order, that merely sharing a sentence links.
LOOSE_PAIRS = ("organization|person", "department|person", "department|organization", "person|person")


def entity_key(kind: Column, text: Column) -> Column:
    """``type:name``, folded."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "^[.,;:]+|[.,;:]+$", "")
    return F.concat(kind, F.lit(":"), F.lower(F.regexp_replace(bare, r"\s+", " ")))


def _claims(text: str, compat: bool, patterns=ENTITY_PATTERNS) -> list[tuple[str, str, int]]:
    """(type, name, place) of every entity; earlier patterns claim their spans."""
    taken: list[tuple[int, int]] = []
    out = []
    for kind, pattern, group in patterns:
        for m in pattern.finditer(text):
            start, end = m.span()
            if kind == "person" and group == 0 and (m[1] in NAME_STOP or m[2] in NAME_STOP):
                continue
            if any(a < end and start < b for a, b in taken):
                continue
            name = m[group]
            if kind == "department":
                if not compat and len(name) <= 2 and not name.isupper():
                    continue  # "it" is mostly a pronoun
                name = DEPARTMENTS[name.lower().translate(_ODD_LETTERS)]
            else:
                taken.append((start, end))
            out.append((kind, name.strip().rstrip("."), start))
    return out


def entity_lists(docs: DataFrame, id_col: str = "doc_id", text: str = "text", compat: bool = False) -> DataFrame:
    """(source, text, found): each document's mentions in a list; the text only of documents that mention two names, which may be related.

    Most texts hold nothing that a pattern could find; Python sees a text only with the patterns whose sign it bears.
    """
    signs = [*ENTITY_SIGNS[:-1], f"{ENTITY_SIGNS[-1]}|{_SHORTER}"] if compat else ENTITY_SIGNS
    kind = pa.list_(pa.struct([("type", pa.string()), ("name", pa.string()), ("place", pa.int32())]))

    @F.arrow_udf("array<struct<type:string,name:string,place:int>>")
    def found(texts: pa.Array) -> pa.Array:
        borne = np.array([pc.match_substring_regex(texts, sign).fill_null(False).to_numpy(zero_copy_only=False) for sign in signs])
        lists = [[]] * len(texts)
        for i in np.flatnonzero(borne.any(axis=0)).tolist():
            patterns = [p for p, b in zip(ENTITY_PATTERNS, borne[:, i], strict=True) if b]
            lists[i] = [{"type": k, "name": n, "place": p} for k, n, p in _claims(texts[i].as_py(), compat, patterns)]
        return pa.array(lists, kind)

    rows = docs.select(F.col(id_col).alias("source"), F.col(text).alias("text"), found(text).alias("found"))
    names = F.array_distinct(F.transform("found", lambda e: F.struct(e["type"], e["name"])))
    return rows.select("source", F.when(F.size(names) > 1, F.col("text")).alias("text"), "found")


def listed_mentions(lists: DataFrame) -> DataFrame:
    """(source, key, type, name, place) of ``entity_lists``."""
    rows = lists.select("source", F.explode("found").alias("e"))
    return rows.select("source", entity_key(F.col("e.type"), F.col("e.name")).alias("key"), F.col("e.type").alias("type"), F.col("e.name").alias("name"), F.col("e.place").alias("place"))


def entity_mentions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", compat: bool = False) -> DataFrame:
    """(source, key, type, name, place): every mention in every document."""
    return listed_mentions(entity_lists(docs, id_col, text, compat))


def entities(mentions: DataFrame) -> DataFrame:
    """Vertices: mentions add up, the first name and source stay."""
    first = F.struct("source", "place", "name")
    return mentions.groupBy("key").agg(F.min_by("name", first).alias("name"), F.first("type").alias("type"), F.min("source").alias("source"), F.count(F.lit(1)).alias("mentions"))


def delete_by_source(mentions: DataFrame, edges: DataFrame, sources: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without what ``sources`` (source) said.

    Vertices are built anew from the other sources' mentions.  With ``compat`` a vertex
    goes with the source that named it first, whoever else mentions it.
    """
    left = edges.join(sources.select(F.col("source").alias("source_document")), "source_document", "left_anti").select(*edges.columns)
    if compat:
        return entities(mentions).join(sources, "source", "left_anti").select("key", "name", "type", "source", "mentions"), left
    return entities(mentions.join(sources, "source", "left_anti")), left


def classify(type_a: Column, type_b: Column, between: Column) -> Column:
    """The relation of two mentions, or null."""
    cue = reduce(lambda c, x: c.when((type_a == x[2]) & (type_b == x[3]) & between.rlike(x[0]), x[1]), CUES, F.when(F.lit(False), F.lit("")))
    pair = F.concat_ws("|", F.least(type_a, type_b), F.greatest(type_a, type_b))
    return cue.when(pair.isin(*LOOSE_PAIRS), "CO_OCCURS")


def relations(docs: DataFrame, mentions: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges (source_key, target_key, type, evidence, source_document) between entities of one sentence.

    An entity is present where its name first occurs, case aside.  Per document and
    relation the first sentence is the evidence.
    """
    split = docs.select(F.col(id_col).alias("source"), F.posexplode(T.sentences(text)).alias("sent", "sentence"))
    names = mentions.groupBy("source", "key", "type").agg(F.min_by("name", "place").alias("name"))
    present = split.join(names, "source").withColumn("at", F.position(F.lower("name"), F.lower("sentence"))).where("at > 0")
    a, b = present.alias("a"), present.select("source", "sent", "key", "type", "name", "at").alias("b")
    both = a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.sent") == F.col("b.sent")) & (F.struct("a.at", "a.key") < F.struct("b.at", "b.key")))
    begin = F.col("a.at") + F.char_length("a.name")
    between = F.when(F.col("b.at") > begin, F.substring(F.col("a.sentence"), begin, F.col("b.at") - begin)).otherwise("")
    found = both.select(
        F.col("a.key").alias("source_key"), F.col("b.key").alias("target_key"), classify(F.col("a.type"), F.col("b.type"), between).alias("type"),
        F.substring(F.trim("a.sentence"), 1, 300).alias("evidence"), F.col("a.source").alias("source_document"), F.col("a.sent").alias("sent"),
    ).where("type is not null")
    return found.groupBy("source_key", "target_key", "type", "source_document").agg(F.min_by("evidence", "sent").alias("evidence"))


def document_edges(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A vertex for each document, keyed by its source, and MENTIONED_IN edges to it."""
    key = F.concat(F.lit("document:"), F.col("source").cast("string"))
    vertices = mentions.select(key.alias("key"), F.col("source").cast("string").alias("name"), F.lit("document").alias("type"), "source", F.lit(1).cast("long").alias("mentions")).distinct()
    edges = mentions.select(F.col("key").alias("source_key"), key.alias("target_key"), F.lit("MENTIONED_IN").alias("type"), F.col("source").alias("source_document"), F.lit("").alias("evidence")).distinct()
    return vertices, edges


def degrees(edges: DataFrame, a: str = "source_key", b: str = "target_key") -> DataFrame:
    """(key, degree): both ends count, a loop twice."""
    ends = edges.select(F.explode(F.array(a, b)).alias("key"))
    return ends.groupBy("key").agg(F.count(F.lit(1)).alias("degree"))


def visualization(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with their degree; 0 without edges."""
    return vertices.join(degrees(edges), "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def search_nodes(vertices: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """Vertices whose name contains a term, case aside."""
    found = vertices.where(F.contains(F.lower("name"), F.lower(F.lit(term))))
    return found.orderBy("key").limit(limit) if limit else found


#: Edges at one vertex that a task of a step takes, about.
HUB_EDGES = 4096


def _steps(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(at, to, part) of all edges, both ways, staged; a hub's edges are dealt over parts."""
    both = edges.select(F.col(a).alias("at"), F.col(b).alias("to")).unionByName(edges.select(F.col(b).alias("at"), F.col(a).alias("to"))).distinct()
    both = staged(both, "steps")
    hubs = both.groupBy("at").agg(F.floor(F.count(F.lit(1)) / HUB_EDGES).cast("int").alias("last")).where("last > 0")
    return staged(both.join(hubs, "at", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("to"), F.col("last") + 1), F.lit(0)).cast("int")).drop("last"), "steps")


def _walk(seeds: DataFrame, edges: DataFrame, depth: int, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(key, block, bits, level) of all that is reached, and (seed, block, bit): 64 seeds walk as the bits of one number.

    A seed starts at the vertex of its name, or with a column ``key`` at all of these.
    A step joins the last level with the edges and merges what arrives by bitwise or, so it costs
    in proportion to edges and blocks of seeds, whatever the seeds have in common; each level is staged.
    """
    numbered = staged(seeds.select("seed").distinct().withColumn("n", F.monotonically_increasing_id()), "seeds")
    numbered = numbered.select("seed", F.shiftright("n", 6).alias("block"), F.col("n").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    steps = _steps(edges, a, b)
    parts = steps.groupBy("at").agg(F.max("part").alias("last")).where("last > 0")
    bits = F.expr("bit_or(shiftleft(1L, bit))")
    starts = numbered.withColumn("key", F.col("seed")) if "key" not in seeds.columns else numbered.join(seeds, "seed")
    frontier = staged(starts.groupBy("key", "block").agg(bits.alias("bits")).withColumn("level", F.lit(0)), "level")
    visited = frontier
    for level in range(1, depth + 1):
        here = frontier.select(F.col("key").alias("at"), "block", "bits").join(parts, "at", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))))).drop("last")
        met = here.join(steps, ["at", "part"]).groupBy(F.col("to").alias("key"), "block").agg(F.bit_or("bits").alias("bits"))
        seen = visited.groupBy("key", "block").agg(F.bit_or("bits").alias("seen"))
        fresh = met.join(seen, ["key", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))))
        frontier = staged(fresh.where("bits <> 0").select("key", "block", "bits", F.lit(level).alias("level")), "level")
        visited = visited.unionByName(frontier)
    return visited, numbered


def _named(walked: DataFrame, numbered: DataFrame) -> DataFrame:
    """Rows with bits as one row per seed."""
    bit = F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1) = 1)"))
    return walked.withColumn("bit", bit).drop("bits").join(numbered, ["block", "bit"]).drop("block", "bit")


def neighbors(seeds: DataFrame, edges: DataFrame, depth: int = 1, a: str = "source_key", b: str = "target_key") -> DataFrame:
    """(seed, key, level) of all vertices within ``depth`` undirected steps; ``seeds`` has seed."""
    return _named(*_walk(seeds, edges, depth, a, b)).select("seed", "key", "level")


def incident_edges(reached: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Edges with an end inside the last level, once per seed."""
    inner = reached.where(F.col("level") < depth).select("seed", "key")
    one = inner.join(edges, inner["key"] == edges["source_key"]).select("seed", *edges.columns)
    two = inner.join(edges, inner["key"] == edges["target_key"]).select("seed", *edges.columns)
    return one.unionByName(two).distinct()


def _grams(label: Column) -> Column:
    """Distinct runs of one to three characters."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(label), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.substring(label, i, n) for n in (1, 2, 3)]))))


def query_seeds(queries: DataFrame, vertices: DataFrame) -> DataFrame:
    """(query_id, key): vertices whose name contains an entity of the query, or else one of its longer words."""
    named = entity_mentions(queries, "query_id").select(F.col("source").alias("query_id"), F.lower("name").alias("term")).distinct()
    words = queries.join(named, "query_id", "left_anti").select("query_id", F.explode(F.filter(F.split("text", r"\s+"), lambda w: F.char_length(w) > 3)).alias("term"))
    terms = named.unionByName(words.select("query_id", F.lower("term").alias("term"))).distinct()
    # a label that contains a term contains the term's first three characters: an equality to join on
    named_vertices = vertices.select("key", F.lower("name").alias("label")).withColumn("gram", F.explode(_grams(F.col("label"))))
    asked = terms.withColumn("gram", F.substring("term", 1, 3))
    return asked.join(named_vertices, "gram").where(F.contains(F.col("label"), F.col("term"))).select("query_id", "key").distinct()


def graph_relations(seeds: DataFrame, vertices: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, related, relations): names near a query's vertices, and its typed edges but for mentions."""
    keys = seeds.select(F.col("key").alias("seed")).distinct()
    reached = neighbors(keys, edges, depth)
    names = reached.where("level > 0").join(vertices.where("type <> 'document'").select("key", "name"), "key").groupBy("seed").agg(F.collect_set("name").alias("names"))
    typed = incident_edges(reached, edges, depth).where("type <> 'MENTIONED_IN'")
    said = typed.groupBy("seed").agg(F.collect_set(F.struct("source_key", "type", "target_key")).alias("edges"))
    per_seed = keys.join(names, "seed", "left").join(said, "seed", "left")
    found = seeds.join(per_seed, seeds["key"] == per_seed["seed"]).groupBy("query_id")
    return found.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("related"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("edges")))).alias("relations"))


def _beside_another(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The seeds (query_id, key) that have another of their query's seeds within ``depth`` steps.

    Two such seeds have a vertex between them, ``depth // 2`` steps or fewer from one and the rest from the other; there two
    seeds meet, so the least and the greatest that come by differ.  Nothing is made for each pair of seeds.
    """
    both = edges.select(F.col("source_key").alias("at"), F.col("target_key").alias("to")).unionByName(edges.select(F.col("target_key").alias("at"), F.col("source_key").alias("to"))).distinct()
    balls = [seeds.select("query_id", "key", F.col("key").alias("at"))]
    for _ in range(depth - depth // 2):
        balls.append(balls[-1].unionByName(balls[-1].join(both, "at").select("query_id", "key", F.col("to").alias("at"))).distinct())
    met = balls[depth // 2].groupBy("query_id", "at").agg(F.min("key").alias("least"), F.max("key").alias("greatest"))
    near = balls[-1].join(met, ["query_id", "at"]).where((F.col("least") != F.col("key")) | (F.col("greatest") != F.col("key")))
    return near.select("query_id", "key").distinct()


def graph_scope(seeds: DataFrame, vertices: DataFrame, edges: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(query_id, source): documents that the neighbourhood of a query's vertices implicates; (query_id, name): entities there beside the vertex itself.

    Queries walk, each from all its vertices: vertices that a query's words name grow in number with the corpus, queries
    don't.  Until the last step what a hub leads to is one row for 64 queries.
    """
    seeds = staged(seeds.select("query_id", "key").distinct(), "starts")
    reached, asked = _walk(seeds.withColumnRenamed("query_id", "seed"), edges, depth, "source_key", "target_key")
    ends = edges.select(F.explode(F.array("source_key", "target_key")).alias("key"), F.col("source_document").alias("source")).distinct()
    touched = reached.where(F.col("level") < depth).join(ends, "key").select("source", "block", "bits")
    nodes = reached.join(vertices.where("type = 'document'").select("key", "source"), "key").select("source", "block", "bits")
    entities_ = vertices.where("type <> 'document'").select("key", "name")
    names = reached.where("level > 0").join(entities_, "key").select("name", "block", "bits")
    own = _beside_another(seeds, edges, depth).join(entities_, "key").select("query_id", "name")  # vertices of a query that another of them leads to
    per_query = lambda rows, by: _named(rows.groupBy(by, "block").agg(F.bit_or("bits").alias("bits")), asked).select(F.col("seed").alias("query_id"), by)
    return per_query(touched.unionByName(nodes), "source"), per_query(names, "name").unionByName(own).distinct()


def graph_documents(seeds: DataFrame, vertices: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, source): documents that the neighbourhood of a query's vertices implicates."""
    return graph_scope(seeds, vertices, edges, depth)[0]
