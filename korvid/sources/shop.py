"""Readers and cleaning for the shop: products, reviews, purchases, stores, papers."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvid.apps.recommend import PLATFORMS, platforms
from korvid.operators.numbering import numbered

LEAST_WORDS = 15
ROOT = "Video Games"
LEGACY = f"{ROOT} > Legacy Systems"
#: The category path of each platform.
ROUTES = {
    "switch": f"{ROOT} > Nintendo Switch",
    "ps5": f"{ROOT} > PlayStation 5",
    "ps4": f"{ROOT} > PlayStation 4",
    "xbox series": f"{ROOT} > Xbox Series X & S",
    "xbox one": f"{ROOT} > Xbox One",
    "pc": f"{ROOT} > PC",
    "vr": f"{ROOT} > Virtual Reality",
    "ps3": f"{LEGACY} > PlayStation Systems > PlayStation 3",
    "ps2": f"{LEGACY} > PlayStation Systems > PlayStation 2",
    "psp": f"{LEGACY} > PlayStation Systems > Sony PSP",
    "psvita": f"{LEGACY} > PlayStation Systems > PlayStation Vita",
    "xbox 360": f"{LEGACY} > Xbox Systems > Xbox 360",
    "3ds": f"{LEGACY} > Nintendo Systems > Nintendo 3DS & 2DS",
    "ds": f"{LEGACY} > Nintendo Systems > Nintendo DS",
    "wii u": f"{LEGACY} > Nintendo Systems > Wii U",
    "wii": f"{LEGACY} > Nintendo Systems > Wii",
    "gamecube": f"{LEGACY} > Nintendo Systems > GameCube",
    "sega": f"{LEGACY} > Sega Systems",
    "mac": f"{ROOT} > Mac",
}
#: The second steps of those paths, and the platforms that have a path of two steps (but one that is no console).
CONSOLES = tuple(dict.fromkeys(path.split(" > ")[1] for path in ROUTES.values()))
CURRENT = tuple(name for name, path in ROUTES.items() if path.count(" > ") == 1 and name != "mac")
#: What marks records of other goods.
OTHER_CATEGORIES = ("Books", "Buy a Kindle", "Movies & TV", "Digital Music", "Grocery")
OTHER_FORMATS = ("Blu-ray", "DVD", "Paperback", "Hardcover", "Mass Market Paperback", "Spiral-bound", "Leather Bound", "Board book", "Kindle Edition", "Library Binding", "Audible Audiobook")
OTHER_DETAILS = r"(?i)^(ISBN|Print length|Hardcover|Paperback|Board book|Spiral-bound|Runtime|Run time|Director|Actors|Contributor|Aspect Ratio|Media Format|MPAA rating|Lexile)"
OTHER_TITLES = (
    r"(?i)\[(?:DVD|Blu-?ray)\b[^\]]*\]|\bDVD Collection\b|\bComplete (?:Movie |TV )?Series\b|\bTV Series\b|\[ART book\]|"
    r"\bboard game\b|\bminiatures battle\b|\bjigsaw puzzle\b|\bstrategy card game\b|\bcodex:"
)


def html_text(column: Column) -> Column:
    """Tags as blanks, the common entities resolved, runs of white space as one blank; in the JVM."""
    out = F.regexp_replace(column, r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def unescaped(column: Column) -> Column:
    """All entities, for texts that hold others than the common ones."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if t is not None else None)

    return run(column)


def price(column: Column) -> Column:
    """A positive price below 100,000, to cents; null for anything else."""
    number = F.regexp_replace(column.cast("string"), r"[$,]", "").try_cast("double")
    return F.when((number > 0) & (number < 100_000), F.round(number, 2))


def image_url(images: Column) -> Column:
    """The main image's, or else the first one's, first address that is one."""
    main = F.filter(images, lambda x: x["variant"] == "MAIN")
    other = F.filter(images, lambda x: ~x["variant"].eqNullSafe(F.lit("MAIN")))
    urls = F.flatten(F.transform(F.concat(main, other), lambda x: F.array(x["large"], x["hi_res"], x["thumb"])))
    return F.get(F.filter(urls, lambda u: u.startswith("http")), F.lit(0))


PRODUCT = """parent_asin string, title string, description array<string>, features array<string>, price string,
images array<struct<variant string, large string, hi_res string, thumb string>>, average_rating double, rating_number long,
store string, categories array<string>, main_category string, details map<string,string>"""


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, compressed or not."""
    return spark.read.schema(PRODUCT).json(path)


def off_topic(excluded: list[str] = ()) -> Column:
    """Records of other goods: listed ones, or by category, format, detail fields or title."""
    details = F.coalesce(F.map_keys("details"), F.array().cast("array<string>"))
    listed = F.col("parent_asin").isin(*excluded) if excluded else F.lit(False)
    found = [
        listed,
        F.col("main_category").isin(*OTHER_CATEGORIES),
        F.try_element_at("details", F.lit("Type of item")).isin(*OTHER_FORMATS),
        F.exists(details, lambda k: k.rlike(OTHER_DETAILS)),
        F.col("title").rlike(OTHER_TITLES),
    ]
    return F.greatest(*[F.coalesce(x, F.lit(False)) for x in found])


def _route_platform(route: Column) -> Column:
    """The platform with the longest path that the route starts with."""
    ordered = sorted(ROUTES.items(), key=lambda kv: -len(kv[1]))
    return F.coalesce(*[F.when((route == path) | route.startswith(path + " > "), name) for name, path in ordered])


def category(categories: Column, title: Column) -> Column:
    """The category path, put right where the title names another platform."""
    parts = F.filter(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    route = F.when(F.size(parts) > 0, F.array_join(parts, " > ")).otherwise(F.lit(ROOT))
    named = platforms(title, F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    only = F.when(F.size(named) == 1, F.element_at(named, 1))
    only = F.when(F.try_element_at(table, only).isNotNull(), only)
    second = F.get(parts, F.lit(1))
    promotional = (F.size(parts) < 2) | (F.get(parts, F.lit(0)) != ROOT) | ~second.isin(*CONSOLES)
    current = _route_platform(route)
    # Several current consoles in the title of a product filed under an old one: the first that is named.
    low = F.lower(F.coalesce(title, F.lit("")))
    places = [F.struct(F.when(F.regexp_instr(low, F.lit(p)) > 0, F.regexp_instr(low, F.lit(p))).otherwise(1 << 30).alias("at"), F.lit(n).alias("name")) for n, p in PLATFORMS if n in CURRENT]
    first = F.array_min(F.filter(F.array(*places), lambda s: s["at"] < (1 << 30)))["name"]
    many = (F.size(named) > 1) & route.startswith(LEGACY + " > ") & (F.size(F.array_except(named, F.array(*map(F.lit, CURRENT)))) == 0)
    skip = F.when((F.size(parts) > 3) & F.get(parts, F.lit(2)).endswith("Systems"), 5).otherwise(4)
    tail = lambda a, n: F.array_join(F.transform(F.slice(a, n, F.greatest(F.size(a), F.lit(1))), lambda x: F.concat(F.lit(" > "), x)), "")
    moved = F.concat(F.try_element_at(table, first), tail(parts, skip))
    rest = F.substring(route, F.length(F.try_element_at(table, current)) + F.lit(1), F.lit(100_000))
    rest = F.when(current == "sega", tail(F.split(rest, " > "), F.lit(3))).otherwise(rest)
    put_right = F.concat(F.try_element_at(table, only), rest)
    return (
        F.when(promotional, F.coalesce(F.try_element_at(table, only), F.lit(ROOT)))
        .when(many, moved)
        .when(only.isNotNull() & current.isNotNull() & (only != current), put_right)
        .otherwise(route)
    )


def products(raw: DataFrame, limit: int | None = None, excluded: list[str] = ()) -> DataFrame:
    """Cleaned products, numbered by reviews; only complete ones of the shop's goods, each once."""
    joined = lambda c: F.array_join(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), " ")
    rows = raw.where(~off_topic(excluded)).select(
        F.col("parent_asin").alias("asin"),
        html_text(F.col("title")).alias("title"),
        F.trim(F.concat_ws(" ", html_text(joined("description")), html_text(joined("features")))).alias("description"),
        price(F.col("price")).alias("price"),
        F.coalesce("average_rating", F.lit(0.0)).alias("rating"),
        F.coalesce("rating_number", F.lit(0)).alias("reviews"),
        F.when(html_text(F.col("store")) != "", html_text(F.col("store"))).otherwise("Desconocida").alias("brand"),
        category(F.col("categories"), F.col("title")).alias("category"),
        image_url(F.col("images")).alias("image_url"),
    )
    words = F.size(F.split("description", r"\s+"))
    rows = rows.where((F.col("asin") != "") & (F.col("title") != "") & F.col("price").isNotNull() & F.col("image_url").isNotNull() & (words >= LEAST_WORDS))
    once = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("asin").orderBy(F.desc("reviews"), "title"))).where("_nth = 1").drop("_nth")
    top = once.orderBy(F.desc("reviews"), "asin").limit(limit) if limit is not None else once
    return numbered(top, [-F.col("reviews"), "asin"], "id")


def clean_purchases(reviews: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """reviews(user, product, ts, rating, verified) -> (id, user, product, ts, rating).

    Verified ones, the first of each user and product, of users with least..most products,
    numbered by time, user and product.
    """
    kept = reviews.where(F.col("verified") & F.col("user").isNotNull() & F.col("product").isNotNull())
    first = kept.groupBy("user", "product").agg(F.min("ts").alias("ts"), F.min_by("rating", "ts").alias("rating"))
    counted = first.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user"))).where(F.col("_n").between(least, most)).drop("_n")
    return numbered(counted, ["ts", "user", "product"], "id")


def stores(raw: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Map elements (one row with an array `elements`) -> stores inside (south, west, north, east).

    Nodes by their own place, ways and relations by their centre; numbered by type and id.
    """
    e = raw.select(F.explode("elements").alias("e"))
    node = F.col("e.type") == "node"
    lat, lon = (F.when(node, F.col(f"e.{c}")).otherwise(F.col(f"e.center.{c}")) for c in ("lat", "lon"))
    tag = lambda k: F.try_element_at("e.tags", F.lit(k))
    rows = e.select(
        F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("osm_id"),
        F.trim(F.regexp_replace(F.coalesce(tag("name"), F.lit("")), r"\s+", " ")).alias("name"),
        F.substring(F.coalesce(tag("shop"), F.lit("")), 1, 20).alias("kind"),
        F.coalesce(*[F.when(tag(k) != "", tag(k)) for k in ("addr:district", "addr:suburb", "addr:city")], F.lit("")).alias("district"),
        F.concat_ws(" ", tag("addr:street"), tag("addr:housenumber")).alias("address"),
        F.struct(F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon")).alias("place"),
        F.when(node, 0).when(F.col("e.type") == "way", 1).otherwise(2).alias("_kind"),
        F.col("e.id").alias("_id"),
    )
    south, west, north, east = box
    rows = rows.where((F.col("name") != "") & F.col("place.lat").between(south, north) & F.col("place.lon").between(west, east))
    return numbered(rows, ["_kind", "_id"], "id").drop("_kind", "_id")


ELEMENTS = "elements array<struct<type string, id long, lat double, lon double, center struct<lat double, lon double>, tags map<string,string>>>"


def read_stores(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    return stores(spark.read.schema(ELEMENTS).json(path, multiLine=True), box)


def balanced_selection(ranked: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """Seeds first (by nth), then the topics in turn by rank, each id once, at most `most`.

    ranked(id, topic, rank), seeds(id, nth).
    """
    rows = ranked.select("id", F.lit(1).alias("tier"), "rank", F.col("topic").alias("place"))
    rows = rows.unionByName(seeds.select("id", F.lit(0).alias("tier"), F.col("nth").alias("rank"), F.lit(0).alias("place")))
    first = rows.groupBy("id").agg(F.min(F.struct("tier", "rank", "place")).alias("at"))
    return first.orderBy("at", "id").limit(most).select("id", F.row_number().over(Window.orderBy("at", "id")).alias("nth"))


def parse_feed(xml: str, topic: str = "") -> list[dict]:
    """Entries of an Atom feed of papers."""
    ns = {"a": "http://www.w3.org/2005/Atom", "x": "http://arxiv.org/schemas/atom"}
    out = []
    for entry in ET.fromstring(xml).findall("a:entry", ns):
        text = lambda path, e=entry: " ".join((e.findtext(path, "", ns) or "").split())
        primary = entry.find("x:primary_category", ns)
        out.append({
            "arxiv_id": re.sub(r"v\d+$", "", text("a:id").rsplit("/abs/", 1)[-1]),
            "title": text("a:title"),
            "authors": ", ".join(" ".join((n.text or "").split()) for n in entry.findall("a:author/a:name", ns)),
            "year": int(text("a:published")[:4] or 0),
            "abstract": text("a:summary"),
            "category": primary.get("term") if primary is not None else "",
            "topic": topic,
        })
    return out


def parse_license(xml: str, default: str | None = None) -> str | None:
    """The licence of a metadata record."""
    for node in ET.fromstring(xml).iter():
        if node.tag.rsplit("}", 1)[-1] == "license" and (node.text or "").strip():
            return node.text.strip()
    return default
