"""Captured payloads to rows: JSON menus of several providers, listing cards, structured data in pages."""

from __future__ import annotations

import html.parser
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

ITEM = ("title", "price", "catalog_name", "description", "image_url")


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _items(rows: DataFrame, key: str, title: Column, price: Column, category: Column, description: Column | None = None, image: Column | None = None, priced: bool = True) -> DataFrame:
    none = F.lit(None).cast("string")
    out = rows.select(key, F.trim(title).alias("title"), price.alias("price"), _blank(category).alias("catalog_name"), (none if description is None else _blank(description)).alias("description"), (none if image is None else _blank(image)).alias("image_url"))
    out = out.where("title <> ''")
    return out.where("price is not null") if priced else out


def category_menu(rows: DataFrame, key: str = "id", payload: str = "payload", items: str = "products", cents: bool = False) -> DataFrame:
    """{categories: [{name, <items>: [{name, price, description, imageUrl}]}]} to items; a price that is no number drops the item."""
    schema = f"struct<categories:array<struct<name:string,{items}:array<struct<name:string,price:string,description:string,imageUrl:string>>>>>"
    c = rows.select(key, F.explode(F.from_json(payload, schema)["categories"]).alias("c")).select(key, "c.name", F.explode(F.col(f"c.{items}")).alias("p"))
    price = F.col("p.price").try_cast("double") / (100 if cents else 1)
    return _items(c, key, F.col("p.name"), F.round(price, 2), F.col("name"), F.col("p.description"), F.col("p.imageUrl"))


def sectioned_store(rows: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """A store's map of sections with items in cents; an item without a price stays."""
    item = "struct<title:string,price:double,imageUrl:string,itemDescription:string,description:string>"
    schema = f"struct<data:struct<catalogSectionsMap:map<string,array<struct<payload:struct<standardItemsPayload:struct<title:struct<text:string>,catalogItems:array<{item}>>>>>>>>"
    sections = rows.select(key, F.explode(F.from_json(payload, schema)["data"]["catalogSectionsMap"])).select(key, F.explode("value").alias("s"))
    flat = sections.select(key, F.col("s.payload.standardItemsPayload.title.text").alias("name"), F.explode("s.payload.standardItemsPayload.catalogItems").alias("i"))
    return _items(flat, key, F.col("i.title"), F.col("i.price") / 100, F.col("name"), F.coalesce(_blank(F.col("i.itemDescription")), F.col("i.description")), F.col("i.imageUrl"), priced=False)


def product_list(rows: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """{result: [{name, list_price, categ_id: [id, name] or false, description_sale}]} to items."""
    schema = "struct<result:array<struct<name:string,list_price:string,categ_id:string,description_sale:string>>>"
    p = rows.select(key, F.explode(F.from_json(payload, schema)["result"]).alias("p"))
    pair = F.from_json("p.categ_id", "array<string>")
    return _items(p, key, F.col("p.name"), F.round(F.col("p.list_price").try_cast("double"), 2), F.when(F.size(pair) == 2, pair[1]), F.col("p.description_sale"))


def point_of_sale(rows: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """Two tables in one payload: templates, left joined with the category named first."""
    schema = "struct<templates:array<struct<name:string,list_price:string,pos_categ_ids:array<long>>>,categories:array<struct<id:long,name:string>>>"
    p = rows.select(key, F.from_json(payload, schema).alias("d")).select(key, F.map_from_entries(F.transform("d.categories", lambda c: F.struct(c["id"], c["name"]))).alias("names"), F.explode("d.templates").alias("t"))
    return _items(p, key, F.col("t.name"), F.round(F.col("t.list_price").try_cast("double"), 2), F.try_element_at("names", F.try_element_at("t.pos_categ_ids", F.lit(1))))


def page_sections(rows: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """{sections: [{heading, items: [{title, price text}]}]} to items."""
    schema = "struct<sections:array<struct<heading:string,items:array<struct<title:string,price:string>>>>>"
    s = rows.select(key, F.explode(F.from_json(payload, schema)["sections"]).alias("s")).select(key, "s.heading", F.explode("s.items").alias("i"))
    return _items(s, key, F.col("i.title"), text.menu_price(F.col("i.price")), F.col("heading"), priced=False)


def valid_items(items: DataFrame, key: str = "id") -> DataFrame:
    """Titles of 3 to 120 characters without interface words, prices of 1 to 200, each pair of both once."""
    noise = r"(?i)^(?:menu|add|order|close|search|cart|total|checkout|login|share|delivery|minimum|subtotal)\b"
    good = F.length("title").between(3, 120) & F.col("price").between(1, 200) & ~F.col("title").rlike(noise)
    return items.where(good).dropDuplicates([key, "title", "price"])


def store_feed(rows: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """Stores of a feed, the first of each identifier; those without one are all kept."""
    schema = "struct<feedItems:array<struct<type:string,uuid:string,store:struct<title:struct<text:string>,rating:struct<text:string>,actionUrl:string>>>>"
    f = rows.select(key, F.posexplode(F.from_json(payload, schema)["feedItems"]).alias("pos", "f")).where("f.type = 'REGULAR_STORE'")
    one = F.when(F.coalesce("f.uuid", F.lit("")) == "", F.concat(F.lit("#"), F.col(key).cast("string"), F.lit("-"), F.col("pos"))).otherwise(F.col("f.uuid"))
    best = f.groupBy(one.alias("uuid_key")).agg(F.min_by(F.struct(F.col("f.uuid").alias("uuid"), F.col("f.store.title.text").alias("name"), F.col("f.store.rating.text").alias("rating"), F.col("f.store.actionUrl").alias("url")), F.struct(F.col(key), F.col("pos"))).alias("s"))
    return best.select("s.uuid", "s.name", text.rating(F.col("s.rating"), comma=False).alias("rating"), "s.url")


FEED_PAGE = "array<struct<type:string,uuid:string,store:struct<storeUuid:string,title:struct<text:string>,actionUrl:string,mapMarker:struct<latitude:double,longitude:double>>>>"


def search_candidates(rows: DataFrame, key: str = "id", pages: str = "pages", base: str = "https://www.ubereats.com") -> DataFrame:
    """What a search answered, feed pages as an array of JSON texts, to candidates as `resolve.presence` takes them.

    Stores in their order, the first of each identifier; those without one are all kept. A page that is no list, a null
    page and null pages give nothing; a search without a store has an empty list. One row stays one row: no shuffle.
    """
    one = lambda p: F.when(F.ltrim(p).startswith("["), F.from_json(p, FEED_PAGE))
    uuid = lambda x: F.coalesce(F.nullif(x["store"]["storeUuid"], F.lit("")), F.nullif(x["uuid"], F.lit("")), F.lit(""))
    feed = F.flatten(F.filter(F.transform(F.coalesce(F.col(pages), F.array().cast("array<string>")), one), F.isnotnull))
    stores = F.filter(feed, lambda x: F.coalesce(x["type"] == "REGULAR_STORE", F.lit(False)))
    first = lambda s: text.bind(F.transform(s, uuid), lambda ids: F.filter(s, lambda x, k: (uuid(x) == "") | (F.array_position(ids, uuid(x)) == k + 1)))
    link = lambda x: F.when(x["store"]["actionUrl"] != "", F.concat(F.lit(base), F.substring_index(x["store"]["actionUrl"], "?", 1))).otherwise("")
    candidate = lambda x: F.struct(
        F.coalesce(x["store"]["title"]["text"], F.lit("Unknown")).alias("name"), link(x).alias("url"), x["store"]["mapMarker"]["latitude"].alias("lat"), x["store"]["mapMarker"]["longitude"].alias("lng"), F.lit(None).cast("string").alias("cuisine")
    )
    return rows.select(key, F.transform(text.bind(stores, first), candidate).alias("candidates"))


def restaurant_state(rows: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """A page's state to a listing: coordinates stand as (longitude, latitude), money in cents."""
    schema = "struct<name:string,location:struct<coordinates:array<double>>,rating:struct<score:double,votes:int>,delivery:struct<fee:int,minOrder:int,etaMin:int,etaMax:int>>"
    r = rows.select(key, F.from_json(payload, schema).alias("r"))
    return r.select(key, "r.name", F.try_element_at("r.location.coordinates", F.lit(2)).alias("lat"), F.try_element_at("r.location.coordinates", F.lit(1)).alias("lng"), F.col("r.rating.score").alias("rating"), F.col("r.rating.votes").alias("review_count"), (F.col("r.delivery.fee") / 100).alias("delivery_fee"), (F.col("r.delivery.minOrder") / 100).alias("min_order"), F.col("r.delivery.etaMin").alias("eta_min"), F.col("r.delivery.etaMax").alias("eta_max"))


def cards(rows: DataFrame, key: str = "id", column: str = "card") -> DataFrame:
    """A listing card's text: the rating line anchors the name above it; fee, minutes and promotions where they stand."""
    lines = F.filter(F.transform(F.split(column, "\n"), F.trim), lambda x: x != "")
    is_rating = lambda x: x.rlike(r"^[1-5][.,]\d(\s|\(|$)")
    out = rows.select(key, lines.alias("l"))
    out = out.withColumn("at", F.array_position(F.transform("l", lambda x: is_rating(x).cast("int")), 1).cast("int"))
    name = F.when(F.col("at") > 1, F.element_at("l", F.greatest(F.col("at") - 1, F.lit(1)))).otherwise(F.try_element_at("l", F.lit(1)))
    found = lambda p: F.try_element_at(F.filter("l", lambda x: x.rlike(p)), F.lit(1))
    fee = found(r"(?i)(€\s*\d|livraison|delivery|levering|gratis|free)")
    minutes = found(r"(?i)\d+\s*(?:[–-]\s*\d+\s*)?min")
    promos = F.filter("l", lambda x: x.rlike(r"(?i)(\d+\s*%|offert|gratuit|buy 1|free item|save|spend)"))
    return out.select(key, name.alias("name"), text.rating(F.when(F.col("at") > 0, F.element_at("l", F.greatest(F.col("at"), F.lit(1))))).alias("rating"), text.menu_price(fee).alias("delivery_fee"), text.eta(minutes).alias("eta_min"), text.eta(minutes, last=True, blank_after_dash=True).alias("eta_max"), text.promotions(promos).alias("promotions"))


LD = r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def structured_restaurant(rows: DataFrame, key: str = "id", page: str = "html") -> DataFrame:
    """The first Restaurant block of a page: name, place, address, phone, cuisine."""
    schema = "struct<`@type`:string,name:string,telephone:string,servesCuisine:string,geo:struct<latitude:double,longitude:double>,address:struct<streetAddress:string,postalCode:string,addressLocality:string>>"
    blocks = F.transform(F.regexp_extract_all(page, F.lit(LD), 1), lambda b: F.from_json(b, schema))
    first = F.try_element_at(F.filter(blocks, lambda b: b["@type"].rlike("Restaurant|FoodEstablishment|LocalBusiness")), F.lit(1))
    r = rows.select(key, first.alias("r")).where("r is not null")
    return r.select(key, "r.name", F.col("r.geo.latitude").alias("lat"), F.col("r.geo.longitude").alias("lng"), F.col("r.address.streetAddress").alias("street_address"), F.col("r.address.postalCode").alias("postal_code"), F.col("r.servesCuisine").alias("cuisine"), text.phone_e164(F.col("r.telephone")).alias("phone"))


class _Menu(html.parser.HTMLParser):
    """Headings carry their text to the cards after them; a card is what a price follows."""

    def __init__(self):
        super().__init__()
        self.heading, self.items, self._tag, self._last = None, [], None, None

    def handle_starttag(self, tag, attrs):
        self._tag = tag

    def handle_data(self, data):
        s = data.strip()
        if not s or self._tag in ("script", "style"):
            return
        price = re.fullmatch(r"(?:€\s*)?(\d{1,3})[.,](\d{2})(?:\s*€)?", s)
        if self._tag in ("h1", "h2", "h3", "h4"):
            self.heading, self._last = s, None
        elif price and self._last:
            self.items.append((self._last, float(f"{price[1]}.{price[2]}"), self.heading))
            self._last = None
        elif not price:
            self._last = s if self._last is None or self._tag in ("h5", "strong", "b") else self._last


def _ld_items(node, category, out):
    if isinstance(node, list):
        for n in node:
            _ld_items(n, category, out)
    elif isinstance(node, dict):
        kind = node.get("@type")
        if kind == "MenuItem":
            offer = node.get("offers") or {}
            offer = offer[0] if isinstance(offer, list) and offer else offer
            try:
                price = float(str((offer or {}).get("price")).replace(",", "."))
            except ValueError:
                price = None
            if (node.get("name") or "").strip():
                out.append((node["name"].strip(), price, category))
        named = node.get("name") if kind == "MenuSection" else category
        for k in ("hasMenu", "hasMenuSection", "hasMenuItem", "@graph", "itemListElement", "item"):
            if k in node:
                _ld_items(node[k], named, out)


def parse_page(page: str | None) -> list[tuple]:
    """Items of a page: structured data if it has three or more, else cards by nearness of a price."""
    out: list[tuple] = []
    for block in re.findall(LD, page or ""):
        try:
            _ld_items(json.loads(block), None, out)
        except ValueError:
            continue
    if len(out) >= 3:
        return out
    menu = _Menu()
    menu.feed(page or "")
    return menu.items[:200]


def page_items(rows: DataFrame, key: str = "id", page: str = "html") -> DataFrame:
    """Items of generic menu pages; walking a page's tree is what has no expression, so it runs over Arrow batches."""
    kind = "array<struct<title:string,price:double,catalog_name:string>>"

    @F.pandas_udf(kind)
    def walk(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [dict(zip(("title", "price", "catalog_name"), i, strict=True)) for i in parse_page(p)])

    return rows.select(key, F.explode(walk(page)).alias("i")).select(key, "i.*")


def phone_of_page(page: Column) -> Column:
    """Structured data first, then an itemprop, then the first number in the text."""
    ld = F.regexp_extract(page, r'"telephone"\s*:\s*"([^"]+)"', 1)
    prop = F.regexp_extract(page, r'itemprop="telephone"[^>]*>([^<]+)<', 1)
    free = F.regexp_replace(page, "<[^>]+>", " ")
    return F.coalesce(text.phone_e164(F.nullif(ld, F.lit(""))), text.phone_e164(F.nullif(prop, F.lit(""))), text.first_phone(free))


def postcode(address: Column) -> Column:
    """The last group of four digits."""
    return F.try_element_at(F.regexp_extract_all(address, F.lit(r"\b(\d{4})\b"), 1), F.lit(-1))


ADAPTERS = (("sq_menu", r"sq-menu\.com|foodbooking\."), ("piki", r"piki-app\.com"), ("odoo_pos", r"odoo\.com.*/pos-self"), ("odoo", r"/shop(?:/|$|\?)"), ("generic", "."))


def adapter(url: Column) -> Column:
    """Which reader takes a link."""
    return F.coalesce(*[F.when(F.lower(url).rlike(p), F.lit(n)) for n, p in ADAPTERS])


def seed_listings(rows: DataFrame) -> DataFrame:
    """Legacy cards whose values are all text, "N/A" for missing, decimal commas and labels for free delivery."""
    known = lambda c: F.nullif(F.trim(F.col(c)), F.lit("N/A"))
    count = F.regexp_replace(known("reviewCount"), r"[^0-9]", "").try_cast("int")
    free = F.lower(known("deliveryFee")).rlike("free|offert|gratuit|gratis")
    return rows.select("name", "url", text.rating(known("rating")).alias("rating"), count.alias("review_count"), text.eta(known("eta")).alias("eta_min"), F.when(free, 0.0).otherwise(text.menu_price(known("deliveryFee"))).alias("delivery_fee"))


def store_details(rows: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """Least order, phone, address and picture of a store, wherever its payload holds them; money in cents."""
    at = lambda *paths: F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, f"$.{p}")), F.lit("")) for p in paths])
    cents = [F.get_json_object(payload, f"$.{p}").try_cast("double") for p in ("minimumOrder", "minOrderAmount", "fareInfo.minimumOrder", "fareInfo.minOrder", "feeInfo.minimumOrder", "deliveryFee.minimumSubtotal", "meta.minSpend")]
    street = at("location.address.streetAddress", "location.address.address1", "location.address.street", "location.streetAddress", "location.address1", "location.street")
    plain = F.when(~F.coalesce(F.get_json_object(payload, "$.location.address"), F.lit("{")).startswith("{"), at("location.address"))
    return rows.select(
        key,
        F.round(F.coalesce(*[F.when(c > 0, c) for c in cents]) / 100, 2).alias("min_order"),
        at("phoneNumber", "phone", "contactInfo.phoneNumber", "contactInfo.phone", "location.phoneNumber").alias("phone"),
        F.coalesce(street, plain).alias("street_address"),
        at("location.address.postalCode", "location.address.postal_code", "location.address.zipCode", "location.address.zip", "location.postalCode", "location.postal_code", "location.zipCode", "location.zip").alias("postal_code"),
        at("heroImageUrls[0].url", "thumbnailImageUrls[0].url", "coverImageUrls[0].url", "trackingImageUrl", "imageUrl").alias("image_url"),
    )


def store_promotions(rows: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """Promotions of a store from three places, by label; a number that a payload gives stands before one read from the label."""
    item = "struct<text:string,title:string,label:string,value:double,minOrder:double>"
    lists = [F.coalesce(F.from_json(F.get_json_object(payload, f"$.{p}"), f"array<{item}>"), F.array().cast(f"array<{item}>")) for p in ("promotions", "offers", "signposts")]
    p = rows.select(key, F.posexplode(F.concat(*lists)).alias("pos", "p"))
    p = p.withColumn("label", F.trim(F.coalesce("p.label", "p.title", "p.text"))).where("coalesce(label, '') <> ''")
    first = p.groupBy(key, F.lower("label").alias("_l")).agg(F.min_by(F.struct("label", "p"), "pos").alias("f")).select(key, "f.label", "f.p", text.promotion(F.col("f.label")).alias("c"))
    return first.select(key, "label", "c.promo_type", F.coalesce("p.value", "c.value").alias("value"), F.coalesce("p.minOrder", "c.min_order").alias("min_order"))


def page_promotions(page: Column) -> Column:
    """Texts of a page that promise something, tags aside, each once."""
    lines = F.transform(F.split(F.regexp_replace(page, "<[^>]+>", "\n"), "\n+"), F.trim)
    return F.array_distinct(F.filter(lines, lambda x: (F.length(x).between(4, 120)) & (text.promotion(x)["promo_type"] != "other")))


def venue_point(lat: Column, lng: Column) -> Column:
    """struct(lat, lng) inside the region, else null."""
    from ..functions import geo

    return F.when(geo.in_region(lat, lng), F.struct(lat.alias("lat"), lng.alias("lng")))
