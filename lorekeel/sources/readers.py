"""Sources: feeds, pages, seed files, bindings of SPARQL results. Fetching is left to a landing job; readers take files
or columns that hold what was fetched."""

from __future__ import annotations

import re
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeel.errors import ValidationError
from lorekeel.schemas import ENTITY_TYPES

ITEM_SCHEMA = "source string, url string, title string, body string, published_text string, feed_order int, entry_order int"
SEED_SCHEMA = "version int, reason string, description string, entities array<struct<canonical_name: string, entity_type: string, subtype: string, description: string, aliases: array<string>>>"
LABELLED_SCHEMA = "articles array<struct<document_id: string, body: string, title: string, url: string, source: string, entities: array<struct<canonical_name: string, entity_type: string>>>>"


# ---------------------------------------------------------------- feeds
_ATOM = "{http://www.w3.org/2005/Atom}"


def feed_items(feeds: DataFrame, linked_only: bool = True) -> DataFrame:
    """Entries of feeds (source, feed_order, xml) in their order, RSS or Atom; a feed that is no XML has none. An entry without link
    is dropped or, on demand, kept with '' as its url."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for source, order, xml in zip(*(batch.column(c).to_pylist() for c in ("source", "feed_order", "xml")), strict=True):
                try:
                    root = ET.fromstring(xml) if xml else None
                except ET.ParseError:
                    root = None
                for k, item in enumerate([] if root is None else [x for x in root.iter() if x.tag in ("item", _ATOM + "entry")]):
                    get = lambda *tags: next((t for tag in tags for v in (item.findtext(tag), item.findtext(_ATOM + tag)) if (t := (v or "").strip())), None)  # noqa: B023, E731
                    ref = next((x.get("href") for x in item.findall(_ATOM + "link") if x.get("rel", "alternate") == "alternate"), None)
                    out.append((source, get("link") or ref or "", get("title") or "", get("description", "summary", "content") or "", get("pubDate", "published", "updated"), order, k))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.string()] * 5 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["source", "url", "title", "body", "published_text", "feed_order", "entry_order"])

    items = feeds.select("source", "feed_order", "xml").mapInArrow(run, ITEM_SCHEMA)
    return items.where("url != ''") if linked_only else items


def feed_date(text: Column) -> Column:
    """The date of a feed entry, e.g. 'Tue, 05 Mar 2024 10:00:00 GMT' or, in Atom, '2024-03-05T10:00:00Z'; NULL where it is none."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", ""), r"\s+(GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm Z")), F.when(F.trim(text).rlike(r"^\d{4}-\d\d-\d\dT"), F.try_to_timestamp(F.trim(text))))


def without_urls(items: DataFrame, pattern: str) -> DataFrame:
    """Entries whose url does not match a pattern (of audio pages, say)."""
    return items.where(~F.col("url").rlike(pattern))


def first_entries(items: DataFrame) -> DataFrame:
    """Each url once: of the first feed, and there its first entry."""
    rest = [c for c in items.columns if c not in ("url", "feed_order", "entry_order")]
    return items.groupBy("url").agg(F.min(F.struct("feed_order", "entry_order", *rest)).alias("f")).select("url", *[F.col(f"f.{c}") for c in rest])


# ---------------------------------------------------------------- pages
class _Article(HTMLParser):
    """Text of the paragraphs of the first article element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.inside, self.now, self.found = 0, False, False, [], []

    def _end(self) -> None:
        if self.inside and (text := "".join(self.now).strip()):
            self.found.append(text)
        self.inside, self.now = False, []

    def handle_starttag(self, tag: str, attrs: Sequence) -> None:
        if tag == "article" and not self.done:
            self.depth += 1
        elif tag == "p" and self.depth:
            self._end()
            self.inside = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self._end()
        elif tag == "article" and self.depth:
            self.depth -= 1
            if not self.depth:
                self._end()
                self.done = True

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.now.append(data)


def article_of(html: str | None) -> str:
    """Paragraphs of the first article of a page, joined by blank lines; '' where there is none."""
    p = _Article()
    p.feed(html or "")
    p.close()
    p._end()
    return "\n\n".join(p.found)


def article_texts(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, text) of pages."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([article_of(x) for x in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    src = pages.select(key, F.col(html).alias("html"))
    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, text string")


# ---------------------------------------------------------------- seeds
def seed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Records of seed files, in the order of the files: stage, pos, canonical_name, entity_type, subtype, description, aliases."""
    out = None
    for stage, path in enumerate(paths):
        one = spark.read.schema(SEED_SCHEMA).option("multiLine", True).json(path).select(F.lit(stage).alias("stage"), F.posexplode("entities").alias("pos", "e"))
        one = one.select("stage", "pos", "e.canonical_name", "e.entity_type", "e.subtype", "e.description", F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no seed file")
    return out


def labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Articles and their expected entities of a labelled file; a type that is none is an error."""
    a = spark.read.schema(LABELLED_SCHEMA).option("multiLine", True).json(path).select(F.explode("articles").alias("a"))
    expected = a.select("a.document_id", F.explode("a.entities").alias("e")).select("document_id", "e.canonical_name", "e.entity_type")
    wrong = expected.where(F.col("entity_type").isNull() | ~F.col("entity_type").isin(*ENTITY_TYPES)).limit(1).collect()
    if wrong:
        raise ValidationError(f"{wrong[0]['document_id']}: {wrong[0]['entity_type']} is no entity type")
    return a.select("a.document_id", "a.title", "a.body", "a.url", "a.source"), expected


def seed_files(spark: SparkSession, folder: str, curated: str = "seed.json", more: str = "wikidata") -> list[str]:
    """The seed files of a folder in the order of their stages: the curated one, then those of the subfolder by name."""
    def listed(path: str) -> list[str]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName().endswith(".json")) if fs.exists(p) else []

    return [x for x in listed(folder) if x.endswith(f"/{curated}")] + listed(f"{folder.rstrip('/')}/{more}")


def single_article(spark: SparkSession, text: str | None = None, path: str | None = None, source: str = "preview") -> DataFrame:
    """One article (document_id, title, body, url, source, doc_type) from a literal text or from a JSON file of an object with those
    names; the id is made from the text where there is none."""
    if (text is None) == (path is None):
        raise ValidationError("give either a text or a file")
    schema = "document_id string, title string, body string, url string, source string, doc_type string"
    if text is not None:
        row = spark.createDataFrame([(None, "", text, "", source, "news")], schema)
    else:
        row = spark.read.schema(schema).option("multiLine", True).json(path)
        if row.where("body is null").limit(1).count():
            raise ValidationError("an article needs a body")
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in (("title", ""), ("url", ""), ("source", source), ("doc_type", "news"))}
    return row.withColumns(filled).withColumn("document_id", F.coalesce("document_id", F.md5("body")))


# ---------------------------------------------------------------- feeds that are known
# Names, kinds and addresses of the feeds.
_BBC = {"top": "", "world": "world/", "business": "business/", "technology": "technology/", "science": "science_and_environment/", "politics": "politics/", "health": "health/", "education": "education/", "entertainment": "entertainment_and_arts/", "uk": "uk/", "asia": "world/asia/", "europe": "world/europe/", "africa": "world/africa/", "latin_america": "world/latin_america/", "middle_east": "world/middle_east/", "us_canada": "world/us_and_canada/"}


def sources(spark: SparkSession) -> DataFrame:
    """(source, feed, feed_order, url, full_text): the registry of feeds; ``full_text`` tells whether the page is fetched as well."""
    rows = [("bbc", k, i, f"https://feeds.bbci.co.uk/news/{x}rss.xml", True) for i, (k, x) in enumerate(_BBC.items())]
    rows += [("ap", "search", 0, news_search("apnews.com"), True), ("reuters", "search", 0, news_search("reuters.com"), False)]
    return spark.createDataFrame(rows, "source string, feed string, feed_order int, url string, full_text boolean")


def news_search(domain: str) -> str:
    """The address of the feed of a news search for one site, of the last day."""
    return f"https://news.google.com/rss/search?q=when:24h+allinurl:{domain}&ceid=US:en&hl=en-US&gl=US"


def redirected(items: DataFrame, decode: Callable[[str], str | None], column: str = "url") -> DataFrame:
    """Items with their addresses as ``decode`` gives them; where it gives none, or fails, the address stays. Each is decoded once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for url in batch.column(0).to_pylist():
                try:
                    out.append(decode(url) or url)
                except Exception:
                    out.append(url)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_from", "_to"])

    found = items.select(F.col(column).alias("_from")).where("_from is not null").distinct().mapInArrow(run, "_from string, _to string")
    return items.join(found, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).select(items.columns)


# ---------------------------------------------------------------- SPARQL
@dataclass(frozen=True)
class Category:
    """How a class of the knowledge base is asked for, and how its rows become entities.

    ``head`` is the sentence with ``{0}`` for the label; ``parts`` are added to it for columns that have a value; ``known`` is a
    sentence that takes the place of the head where the first column has one.
    """

    entity_type: str
    subtype: str
    instance_of: str
    head: str
    parts: tuple[tuple[tuple[str, ...], str], ...] = ()
    known: tuple[str, str] | None = None
    ids: tuple[tuple[str, str], ...] = ()  # prefix of an alias, and its column
    subclasses: bool = True
    without: tuple[str, ...] = ()  # classes that are left out
    unwanted: tuple[str, ...] = ()  # items that are left out
    needed: tuple[tuple[str, str], ...] = ()  # property and variable an item must have
    asked: tuple[tuple[str, str], ...] = ()  # property and variable that it may have
    labels: tuple[str, ...] = ()  # variables whose labels are asked for


# Classes and properties of the knowledge base, the sentences of descriptions, the prefixes of ids.
CATEGORIES = {
    "company": Category(
        "organization", "company", "Q4830453", "{0} is a publicly listed company",
        ((("countryLabel",), "headquartered in {0}"), (("exchangeLabel", "ticker"), "listed on {0} under ticker {1}"), (("exchangeLabel",), "listed on {0}"), (("ticker",), "trading under ticker {0}")),
        ids=(("ticker", "ticker"), ("isin", "isin")), without=("Q66344",), needed=(("p:P414", "listing"),), asked=(("wdt:P946", "isin"), ("wdt:P17", "country")), labels=("exchange", "country"),
    ),
    "central_bank": Category("organization", "central_bank", "Q66344", "{0} is a central bank", known=("countryLabel", "{0} is the central bank of {1}. Sets monetary policy and influences the country's currency"), asked=(("wdt:P17", "country"),), labels=("country",)),
    "regulator": Category("organization", "regulator", "Q105062392", "{0} is a financial regulatory authority", known=("countryLabel", "{0} is a financial regulatory authority in {1}"), asked=(("wdt:P17", "country"),), labels=("country",)),
    "exchange": Category("organization", "exchange", "Q11691", "{0} is a stock exchange", known=("countryLabel", "{0} is a stock exchange based in {1}"), ids=(("mic", "mic"),), subclasses=False, without=("Q22687", "Q806735", "Q438711", "Q1137319", "Q5468383"), unwanted=("Q5973741", "Q93355333"), asked=(("wdt:P17", "country"), ("wdt:P2283", "mic")), labels=("country",)),
    "currency": Category("asset", "currency", "Q8142", "{0} is a fiat currency", ((("iso",), "with ISO 4217 code {0}"), (("countryLabel",), "issued by {0}")), ids=(("iso", "iso"),), needed=(("wdt:P498", "iso"),), asked=(("wdt:P17", "country"),), labels=("country",)),
    "index": Category("asset", "index", "Q223371", "{0} is a stock market index", ((("exchangeLabel",), "tracked on {0}"), (("countryLabel",), "in {0}")), asked=(("wdt:P414", "exchange"), ("wdt:P17", "country")), labels=("exchange", "country")),
    "crypto": Category("asset", "crypto", "Q13479982", "{0} is a cryptocurrency", known=("symbol", "{0} is a cryptocurrency trading under symbol {1}"), ids=(("symbol", "symbol"),), subclasses=False, asked=(("wdt:P498", "symbol"),)),
}


def sparql(category: str, limit: int) -> str:
    """The query of a category: distinct items up to a limit first, then what they may have, so that the limit counts items."""
    if limit <= 0:
        raise ValidationError("limit must be positive")
    k = CATEGORIES[category]
    under = lambda q, deep=True: f"wdt:P31{'/wdt:P279*' if deep else ''} wd:{q}"
    listing = ("p:P414", "listing") in k.needed
    inner = [f"?item {under(k.instance_of, k.subclasses)} ."] + [f"?item {p} ?{v} ." for p, v in k.needed]
    inner += ["?listing ps:P414 ?exchange ."] if listing else []
    inner += [f"MINUS {{ ?item {under(q)} . }}" for q in k.without]
    inner += [f"FILTER(?item NOT IN ({', '.join('wd:' + q for q in k.unwanted)}))"] if k.unwanted else []
    kept = ["item", *[v for _, v in k.needed], *(["exchange"] if listing else [])]
    optional = [f"OPTIONAL {{ ?item {p} ?{v} . }}" for p, v in k.asked] + (["OPTIONAL { ?listing pq:P249 ?ticker . }"] if listing else [])
    optional.append('OPTIONAL { ?item schema:description ?description . FILTER(LANG(?description) = "en") }')
    shown = dict.fromkeys(["item", "itemLabel", "description", *[v for _, v in (*k.needed, *k.asked) if v != "listing"], *(["ticker", "exchange"] if listing else []), *[f"{v}Label" for v in k.labels]])
    lines = ["SELECT " + " ".join(f"?{v}" for v in shown), "WHERE {", "  { SELECT DISTINCT " + " ".join(f"?{v}" for v in kept), "    WHERE {", *[f"      {x}" for x in inner], f"    }} LIMIT {limit} }}"]
    return "\n".join([*lines, *[f"  {x}" for x in optional], '  SERVICE wikibase:label { bd:serviceParam wikibase:language "en" . }', "}"])


RETRIED = (429, 500, 502, 503, 504)


def fetched(query: str, send: Callable[[str], tuple[int, str]], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> str:
    """The answer to a query. ``send`` gives status and body; busy and failing servers are asked again, after 1, 2, 4 .. seconds."""
    for k in range(attempts):
        status, body = send(query)
        if status == 200:
            return body
        if status not in RETRIED or k == attempts - 1:
            raise ConnectionError(f"status {status}")
        wait(2.0**k)
    raise ConnectionError("no attempt was made")


def bindings(landed: DataFrame, columns: Sequence[str], body: str = "body") -> DataFrame:
    """Rows of landed answers (JSON of SPARQL results): each variable of ``columns`` as a string, NULL where it is unbound."""
    value = "struct<value: string>"
    schema = f"results struct<bindings: array<struct<{', '.join(f'{c}: {value}' for c in columns)}>>>"
    rows = landed.select(F.explode(F.from_json(body, schema)["results"]["bindings"]).alias("b"))
    return rows.select(*[F.nullif(F.col(f"b.{c}.value"), F.lit("")).alias(c) for c in columns])


def _sentence(pattern: str, *columns: Column) -> Column:
    parts = re.split(r"\{(\d)\}", pattern)
    return F.concat(*[columns[int(x)] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x or i % 2])


def described(category: str, label: Column, has: Callable[[str], Column]) -> Column:
    """The description of an item: its sentence, with the parts it has values for (of parts with the same column the first)."""
    k = CATEGORIES[category]
    out = _sentence(k.head, label)
    if k.known:
        out = F.when(has(k.known[0]).isNotNull(), _sentence(k.known[1], label, has(k.known[0]))).otherwise(out)
    said: dict[str, list[Column]] = {}
    for columns, pattern in k.parts:
        free = [~x for c in columns for x in said.get(c, ())]
        mine = reduce(lambda a, b: a & b, [has(c).isNotNull() for c in columns] + free)
        out = F.concat(out, F.when(mine, F.concat(F.lit(", "), _sentence(pattern, *[has(c) for c in columns]))).otherwise(""))
        for c in columns:
            said.setdefault(c, []).append(mine)
    return F.concat(out, F.lit("."))


def bindings_to_entities(rows: DataFrame, category: str) -> DataFrame:
    """Entities of query rows (item, itemLabel, description and the columns of the category, all strings): external_id,
    canonical_name, entity_type, subtype, description, aliases. Rows without a label, or with the id for a label, are dropped;
    a description of the knowledge base follows the sentence."""
    k = CATEGORIES[category]
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    qid = F.substring_index("item", "/", -1)
    extra = has("description")
    text = F.concat(described(category, has("itemLabel"), has), F.when(extra.isNotNull(), F.concat(F.lit(" "), extra)).otherwise(""))
    ids = F.array_compact(F.array(F.concat(F.lit("wikidata:"), qid), *[F.when(has(c).isNotNull(), F.concat(F.lit(f"{p}:"), has(c))) for p, c in k.ids]))
    ok = has("item").isNotNull() & has("itemLabel").isNotNull() & (has("itemLabel") != qid)
    return rows.where(ok).select(qid.alias("external_id"), has("itemLabel").alias("canonical_name"), F.lit(k.entity_type).alias("entity_type"), F.lit(k.subtype).alias("subtype"), text.alias("description"), ids.alias("aliases"))


def imported(landed: DataFrame, category: str) -> DataFrame:
    """Landed answers of a category as entities, rows of the same item as one with the aliases of all, in the order of their text."""
    k = CATEGORIES[category]
    columns = list(dict.fromkeys(["item", "itemLabel", "description", *[c for part, _ in k.parts for c in part], *([k.known[0]] if k.known else []), *[c for _, c in k.ids]]))
    rows = bindings_to_entities(bindings(landed, columns), category)
    first = F.min(F.struct("description", "canonical_name", "entity_type", "subtype")).alias("f")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("description", "aliases"))), lambda x: x["aliases"])
    return rows.groupBy("external_id").agg(first, F.array_distinct(F.flatten(lists)).alias("aliases")).select("external_id", "f.canonical_name", "f.entity_type", "f.subtype", "f.description", "aliases")


def archive_queries(spark: SparkSession, base: str, day_from: str, day_to: str) -> DataFrame:
    """(day, url): one query of an archive for each day of a closed range."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(day_from).cast("date"), F.lit(day_to).cast("date"))).alias("day"))
    return days.select("day", F.format_string(base + " after:%s before:%s", F.col("day").cast("string"), F.date_add("day", 1).cast("string")).alias("url"))
