"""Names, titles, promotions, prices, phones and links, as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def _plain_letters() -> tuple[str, str]:
    """Every precomposed letter below U+2000 that is one base letter and marks, and that base letter."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) for c in range(0xC0, 0x2000)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()


def strip_accents(c: Column) -> Column:
    """Letters without their marks."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")


def bind(c: Column, f) -> Column:
    """f of c, with c worked out once however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _keep_if_any(old: Column, step) -> Column:
    """step(old), or old where that would leave nothing."""
    return bind(old, lambda x: bind(step(x), lambda new: F.when(F.length(new) > 0, new).otherwise(x)))


def canonical(c: Column) -> Column:
    """A name without symbols, " - place", a trailing city or a trailing dietary label."""
    s = F.trim(F.regexp_replace(F.trim(c), r"[^ -ɏḀ-ỿ\s\d'\"\-&().!,]", ""))
    s = F.trim(F.regexp_replace(s, r"(?s)\s+-\s+\S.*$", ""))
    s = F.trim(F.regexp_replace(s, r"(?i)\s+(?:brussels|bruxelles|bxl|bsl)\s*$", ""))
    return F.trim(F.regexp_replace(s, r"(?iu)\s+(?:halal|bio|vegan|végétalien|casher|kosher)\s*$", ""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_key(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(strip_accents(canonical(c))), "[^a-z0-9]", "")


def name_words(c: Column) -> Column:
    """Lower-case words with single blanks."""
    return squeeze(F.regexp_replace(F.lower(strip_accents(canonical(c))), r"[^a-z0-9\s]", " "))


def match_form(c: Column) -> Column:
    """The canonical name in lower case without accents; curly quotes become straight ones first."""
    return squeeze(strip_accents(F.lower(canonical(F.regexp_replace(c, "[‘’ʼ´`]", "'")))))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def among(t: Column, values) -> Column:
    return t.isin(*values)


def first_word(c: Column) -> Column:
    """The first word of a name that is no article, else its first word, else empty."""
    w = words(name_words(c))
    real = F.filter(w, lambda t: ~among(t, dims.ARTICLES))
    return F.coalesce(F.try_element_at(real, F.lit(1)), F.try_element_at(w, F.lit(1)), F.lit(""))


def distinctive_words(c: Column) -> Column:
    """Words of four letters or more that are no article, shop type or place."""
    return F.array_distinct(F.filter(words(name_words(c)), lambda t: (F.length(t) >= 4) & ~among(t, dims.GENERIC + dims.ARTICLES + dims.LOCATIONS)))


def remainder(c: Column) -> Column:
    """What follows the leading shop types and articles, and whether a shop type was among them."""
    state = F.struct(F.array().cast("array<string>").alias("rest"), F.lit(False).alias("generic"))

    def step(s, t):
        leading = (F.size(s["rest"]) == 0) & among(t, dims.GENERIC + dims.ARTICLES)
        rest = F.when(leading, s["rest"]).otherwise(F.concat(s["rest"], F.array(t)))
        return F.struct(rest.alias("rest"), (s["generic"] | (leading & among(t, dims.GENERIC))).alias("generic"))

    return F.aggregate(words(name_words(c)), state, step, lambda s: F.struct(F.array_join(s["rest"], " ").alias("rest"), s["generic"].alias("generic")))


def slug_key(c: Column) -> Column:
    """A link's last segment as a key, empty if it names a page or a place."""
    s = F.regexp_replace(strip_accents(F.lower(c)), r"[\-_]?(?:brussels|bruxelles|bxl|bsl)[\-_]?", "")
    s = F.regexp_replace(s, "[^a-z0-9]", "")
    return F.when((F.length(s) < 4) | among(s, dims.GENERIC_SLUGS + dims.LOCATIONS), "").otherwise(s)


def path_slug(url: Column) -> Column:
    """The last path segment of three characters or more that is no long identifier."""
    path = F.try_parse_url(url, F.lit("PATH"))
    parts = F.filter(F.reverse(F.split(path, "/")), lambda p: (F.length(p) >= 3) & ~p.rlike("^[A-Za-z0-9_-]{20,}$"))
    return F.lower(F.try_element_at(parts, F.lit(1)))


def domain(url: Column) -> Column:
    """The registrable part of a link's host; three labels under co, com, org or net of a country."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    host = F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", "")
    labels = F.split(host, r"\.")
    n = F.size(labels)
    deep = (n >= 3) & F.try_element_at(labels, F.lit(-2)).isin("co", "com", "org", "net") & (F.length(F.try_element_at(labels, F.lit(-1))) == 2)
    return F.when(url.contains(".") & (n >= 2), F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)))


def phone_digits(c: Column) -> Column:
    """Digits without the country's prefix or leading zeros; null if none are left."""
    d = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\D", ""), "^32", ""), "^0+", "")
    return F.when(F.length(d) > 0, d)


def phone_e164(c: Column) -> Column:
    """A Belgian number in international form; null if it has too few or too many digits."""
    d = F.regexp_replace(c, r"[^0-9+]", "")
    d = F.when(d.startswith("+32"), F.substring(d, 4, 40)).when(d.startswith("0032"), F.substring(d, 5, 40)).when(d.startswith("0"), F.substring(d, 2, 40))
    d = F.regexp_replace(d, "^0", "")
    return F.when(d.rlike("^[1-9][0-9]{7,8}$"), F.concat(F.lit("+32"), d))


def first_phone(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"((?:\+32|0032|0)[\s./()-]*[1-9](?:[\s./()-]*[0-9]){7,8})(?![0-9])"), 1)
    return F.try_element_at(F.filter(F.transform(found, phone_e164), lambda p: p.isNotNull()), F.lit(1))


# Fixed value: words that a street begins with.
STREETS = r"^(?:rue|avenue|av|boulevard|bvd|bd|chaussee|ch[eé]e|dr[eè]ve|place|pl|square|sq|clos|impasse|all[eé]e|quai|passage|sentier|chemin|ch|dreve|ruelle|voie|cit[eé])\s+"


def address_key(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(F.trim(c))), STREETS, ""), "[^a-z0-9]", ""), F.lit(""))


def house_number(c: Column) -> Column:
    """The number that ends the address, else the one that begins it, without its letter."""
    s = F.trim(c)
    end = F.regexp_extract(s, r"\b(\d+)\s*[a-zA-Z]?\s*$", 1)
    start = F.regexp_extract(s, r"^\s*(\d+)\s*[a-zA-Z]?\b", 1)
    return F.when(end != "", end).when(start != "", start)


def places(name: Column, slugs: Column | None = None) -> Column:
    """Places named in a raw name or its slugs."""
    squash = lambda c: F.regexp_replace(F.lower(strip_accents(c)), "[^a-z]", "")
    texts = F.array(squash(name)) if slugs is None else F.concat(F.array(squash(name)), F.transform(F.coalesce(slugs, F.array().cast("array<string>")), squash))
    known = F.array(*[F.lit(x) for x in dims.LOCATIONS])
    return F.filter(known, lambda p: F.exists(texts, lambda t: F.contains(t, p)))


# Fixed value: texts that are captured in place of a name.
JUNK = (
    r"(around\s+\d|environ\s+\d+\s*min|pre[\s-]?order\s+\d|pré[\s-]?commande\s+\d|article\s+offert|\bplats?\s+offert|\d+\s*plats?\s+achet"
    r"|profitez\s+de|\d+e?\s*à\s*moiti|\d+\s*%\s+off|-\s*\d+\s*%|•\s*à\s+partir|\d+e\s+à\s+moitié)"
)


def is_junk(name: Column) -> Column:
    """Whether a captured name is a promotion tile or an arrival label."""
    s = F.lower(F.trim(F.regexp_replace(name, r"\p{Cf}", "")))
    return (F.length(s) <= 300) & s.rlike(JUNK)


def cuisine(name: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(name).rlike(p), label) for label, p in dims.CUISINES])


# Promotions. The patterns by kind, in order.
FREE_DELIVERY = (
    r"€0 delivery|livraison (gratuite|offerte)|gratis (levering|lieferung)|free delivery|kostenlose lieferung|get €0 delivery|0\s*€ (de livraison|livraison)"
    r"|livraison.{0,30}gratuite|delivery.{0,20}free|gratuite.{0,20}livraison"
)
BOGO = (
    r"buy 1.{0,8}get 1|1 (achet|plat achet).{0,8}(offert|gratuit)|kaufe 1.{0,8}(gratis|kostenlos)|get 1 free|1 kostenlos|erhalte 1|2 (for|pour) (1|un)|2-for-1"
)
FREE_ITEM = (
    r"free item|article offert|produit offert|kostenloser artikel|add a free item|gratis artikel|offert dès|1 (article|produit) (offert|gratuit)|item offert|free article"
)
PERCENT = r"(\d+)\s*%"
AMOUNT = r"(?:spare|save|économise[zr]?|remise de|rabatt)\s+(?:€\s*)?(\d+(?:[,.]\d+)?)(?:\s*€)?"
SPEND = r"^spend\s+€|^zahle\s+\d|^dépense|^besteed"
MIN_ORDER = (
    r"orders?\s+(?:over|above|of)\s+[€$£]?\s*(\d+(?:[,.]\d+)?)",
    r"orders?\s+[€$£]\s*(\d+(?:[,.]\d+)?)\s*\+",
    r"(?:dès|à partir de)\s+[€$£]?\s*(\d+(?:[,.]\d+)?)(?:\s*[€$£])?",
    r"vanaf\s+[€$£]?\s*(\d+(?:[,.]\d+)?)",
    r"ab\s+(?:einem\s+warenwert\s+von\s+)?[€$£]?\s*(\d+(?:[,.]\d+)?)",
    r"spend\s+[€$£]\s*(\d+(?:[,.]\d+)?)",
    r"\(?zahle\s+(\d+(?:[,.]\d+)?)(?:\s*[€$£])?\)?",
    r"(?:pour|for).{0,20}(?:≥|>=|>|de)\s*[€$£]?\s*(\d+(?:[,.]\d+)?)",
    r"(?:min|minimum)[.:\s]+[€$£]?\s*(\d+(?:[,.]\d+)?)",
    r"(?:commande|order)\s+(?:de\s+|d'au moins\s+|of\s+|minimum\s+)?[€$£]?\s*(\d+(?:[,.]\d+)?)",
    r"(\d+(?:[,.]\d+)?)\s*[€$£](?:\s+d'achat|\s+minimum|\s+min\.?)?$",
)


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def min_order(text: Column) -> Column:
    """The least spend a promotion asks for."""
    return F.coalesce(*[_number(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in MIN_ORDER])


def promotion(text: Column) -> Column:
    """struct(promo_type, label, value, min_order)."""
    low = F.lower(text)
    kinds = (
        ("free_delivery", low.rlike(FREE_DELIVERY), F.lit(0.0)),
        ("bogo", low.rlike(BOGO), F.lit(None).cast("double")),
        ("free_item", low.rlike(FREE_ITEM), F.lit(None).cast("double")),
        ("pct_discount", low.rlike(PERCENT), _number(F.regexp_extract(low, PERCENT, 1))),
        ("abs_discount", low.rlike(AMOUNT), _number(F.regexp_extract(low, AMOUNT, 1))),
        ("spend_save", low.rlike(SPEND), F.lit(None).cast("double")),
    )
    kind, value = F, F
    for name, holds, v in kinds:
        kind, value = kind.when(holds, F.lit(name)), value.when(holds, v)
    kind = kind.otherwise("other")
    return F.struct(kind.alias("promo_type"), text.alias("label"), value.alias("value"), F.when(kind != "other", min_order(low)).alias("min_order"))


def promotions(texts: Column) -> Column:
    """Promotions of an array of labels: trimmed, the first of labels that differ in case only."""
    t = F.filter(F.transform(texts, F.trim), lambda x: x != "")
    first = F.filter(t, lambda x, i: F.array_position(F.transform(t, F.lower), F.lower(x)) == i + 1)
    return F.transform(first, promotion)


def menu_price(c: Column) -> Column:
    """Euros of a price text: free words, else two decimals, else the first whole number."""
    exact = F.concat_ws(".", F.nullif(F.regexp_extract(c, r"(\d+)[,.](\d{2})", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"(\d+)[,.](\d{2})", 2), F.lit("")))
    whole = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(F.lower(c).rlike(r"\b(gratuit|free|gratis)\b"), 0.0).when(exact != "", exact.try_cast("double")).when(whole != "", whole.try_cast("double"))


def rating(c: Column, comma: bool = True) -> Column:
    """The first number; with comma False a decimal comma ends it, as one of the sources has it."""
    m = F.nullif(F.regexp_extract(c, r"(\d+(?:[.,]\d+)?)" if comma else r"(\d+(?:\.\d+)?)", 1), F.lit(""))
    return F.replace(m, F.lit(","), F.lit(".")).try_cast("double")


def eta(c: Column, last: bool = False, blank_after_dash: bool = False) -> Column:
    """Minutes: the first number, or the second of a range."""
    dash = r"\s*[–-]\s*" if blank_after_dash else r"\s*[–-]"
    m = F.regexp_extract(c, r"(\d+)" + (dash + r"(\d+)" if last else ""), 2 if last else 1)
    return F.nullif(m, F.lit("")).try_cast("int")


# Menu titles
EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B50}\\x{2B55}\\x{231A}\\x{231B}\\x{23E9}-\\x{23FA}\\x{FE0F}]"


def title_words(c: Column) -> Column:
    """A menu title without emoji, accents, brackets, size, pieces, quantity, menu number and punctuation.

    A step that would leave nothing is not taken.
    """
    s = F.lower(F.regexp_replace(strip_accents(F.regexp_replace(c, EMOJI, "")), "['’‘]", ""))
    s = _keep_if_any(s, lambda x: squeeze(F.regexp_replace(x, r"\s*\([^)]*\)\s*", " ")))
    for p in (r"\s+\d+([.,]\d+)?\s*(cl|ml|dl)\s*$", r"\s+\d+\s*(pcs?|pieces?|stuks?|st\.?)\s*$", r"^\d+\s*(x|stuks?|pcs|pieces?|st)\s+", r"^\d+[\s\-.):]+\s*"):
        s = _keep_if_any(s, lambda x, p=p: F.trim(F.regexp_replace(x, p, "")))
    return squeeze(F.regexp_replace(s, r"[^\p{L}\p{N}\s]", " "))


def title_key(title: Column, category: Column | None = None) -> Column:
    """Words of a title in order of the alphabet, without a leading category, and without filler if two are left."""
    w = F.split(title_words(title), r"\s+")
    if category is not None:

        def without(w: Column, c: Column) -> Column:
            n = F.size(c)
            return F.when((n > 0) & (n < F.size(w)) & (F.slice(w, 1, F.greatest(n, F.lit(1))) == c), F.slice(w, n + 1, F.size(w))).otherwise(w)

        w = bind(w, lambda x: bind(words(F.coalesce(title_words(category), F.lit(""))), lambda c: without(x, c)))

    def key(w: Column) -> Column:
        real = F.filter(w, lambda t: ~among(t, dims.TITLE_STOPWORDS))
        return F.array_join(F.when(F.size(real) >= 2, real).otherwise(w), " ")

    return bind(F.array_sort(w), key)


# Links. Hosts that take orders, paths of menus, links that lead nowhere, sites of chains.
ORDER_HOSTS = (
    r"(?i)sq-menu\.com|piki-app\.com|lightspeedrestaurant\.com|wixrestaurants\.com|flipdish\.|livepepper\.|obypay\.|foodbooking\.|orderyoyo\.|clickeat\."
    r"|square\.site|app\.orda\.io|orderingstack\.|yummyfood\.be|order\.me/|app\.fritzy\.be"
)
MENU_PATHS = r"(?i)(?:^|-|/)(menu|carte|kaart|menukaart)(?:$|/|-)"
JUNK_LINKS = (
    r"(?i)ubereats\.com|deliveroo\.|takeaway\.com|just-eat\.|thuisbezorgd\.|google\.com/searchviewer|zenchef\.com|tablebooker\.com|reservations?\.|bookings?\."
    r"|\.pdf$|linktr\.ee|digilink\.io|bit\.ly/|sprd\.li/|/terms(-of[- _]?(use|service))?(/|$)|/privacy(-policy)?(/|$)|/legal(/|$)|/conditions(-g[eé]n[eé]rales)?(/|$)"
    r"|/cgv(/|$)|/contact(/|$)|/about(-us)?(/|$)|/faq(/|$)|/sitemap|/cookie"
)
CHAIN_HOSTS = r"(?i)subway\.com|mcdonalds\.com|kfc\.com|burgerking\.com|pizzahut\.com|dominos\.com|starbucks\.com|quick\.be|tgifridays\.com|papajohns\.com"


def is_junk_link(url: Column) -> Column:
    return F.coalesce(url.rlike(JUNK_LINKS), F.lit(False))


def link_type(url: Column, phone: Column) -> Column:
    """ordering, menu, website or phone."""
    host = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    coded = (F.size(F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")) > 2) | ((F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(1)) == "api"))
    shared = host.contains("sq-menu.com") | host.contains("foodbooking.com")
    return (
        F.when(F.coalesce(url, F.lit("")) == "", F.when(F.coalesce(phone, F.lit("")) != "", "phone").otherwise("website"))
        .when(host.rlike(CHAIN_HOSTS), "website")
        .when(host.contains("odoo.com") & path.contains("pos-self"), "ordering")
        .when(host.rlike(ORDER_HOSTS), F.when(shared & ~coded, "menu").otherwise("ordering"))
        .when(path.rlike(MENU_PATHS), "menu")
        .otherwise("website")
    )


def covered_domain(url: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(url).contains(d), d) for d in dims.COVERED])


def order_channel(url: Column, phone: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(covered_domain(url).isNotNull(), "covered_platform").when(has(url) | has(phone), "direct").otherwise("unknown")


def commune(postal: Column, place: Column) -> Column:
    """A commune's slug by postal code, else by exact alias, else by the first alias inside the place."""
    by_code = {str(code): slug for slug, _, _, codes, _, _ in dims.COMMUNES for code in codes}
    aliases = [(alias, slug) for slug, _, _, _, names, _ in dims.COMMUNES for alias in names]
    code = postal.try_cast("int").cast("string")
    table = F.create_map(*[F.lit(x) for kv in by_code.items() for x in kv])
    needle = F.lower(F.trim(place))
    exact = F.create_map(*[F.lit(x) for kv in aliases for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.try_element_at(exact, needle), *[F.when(needle.contains(a), s) for a, s in aliases])


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip_accents(F.lower(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(s, 1, 60)


# Labels
def euros(cents: Column, none: str = "—") -> Column:
    return F.when(cents.isNull(), none).when(cents == 0, "Free").otherwise(F.concat(F.lit("€"), F.format_string("%.2f", cents / 100.0)))


def fee_label(fee: Column) -> Column:
    return F.when(fee == 0, "Free").otherwise(F.concat(F.lit("€"), F.format_string("%.2f", fee.cast("double"))))


def eta_label(lo: Column, hi: Column) -> Column:
    return F.when(hi.isNotNull() & (hi != lo), F.concat(lo, F.lit("–"), hi, F.lit(" min"))).otherwise(F.concat(lo, F.lit(" min")))


def saving_label(kind: Column, value: Column) -> Column:
    """What a deal saves, in words; null where it can't be told."""
    return (
        F.when((kind == "pct_discount") & value.isNotNull(), F.concat(F.lit("Save ~€"), F.format_string("%.2f", value * 20 / 100), F.lit(" on a €20 order")))
        .when((kind == "abs_discount") & value.isNotNull(), F.concat(F.lit("€"), F.format_string("%.2f", value), F.lit(" off your order")))
        .when(kind == "free_delivery", "€0 delivery fee")
    )


def word_overlap(a: Column, b: Column) -> Column:
    """Common words over the longer list of words; 0 if either has none."""
    x, y = F.array_distinct(words(name_words(a))), F.array_distinct(words(name_words(b)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(0.0)


def is_order_link(url: Column) -> Column:
    """Whether a link leads to an order page of the merchant's own."""
    return F.coalesce(url.rlike(r"(?i)order|commander|bestel|shop|menu|" + ORDER_HOSTS.removeprefix("(?i)")) & ~url.rlike(JUNK_LINKS), F.lit(False))


def menu_code(url: Column) -> Column:
    """The restaurant's code in a link: a path segment after /api/<type>/, else the own subdomain."""
    host = F.regexp_replace(F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")), r"^www\.", "")
    path = F.nullif(F.regexp_extract(url, r"/api/[^/]+/([^/?#]+)", 1), F.lit(""))
    return F.coalesce(path, F.when(F.size(F.split(host, r"\.")) > 2, F.split(host, r"\.")[0]))


def shop_slug(url: Column) -> Column:
    """The first path segment of a link."""
    return F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/([^/]+)", 1), F.lit(""))


def strip_html(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "<[^>]*>", " "))


def zone(postal: Column) -> Column:
    """The commune of a postal code alone."""
    return commune(postal, F.lit(None).cast("string"))


def commune_name(slug_: Column, dutch: bool = False) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for c in dims.COMMUNES for x in (c[0], c[2 if dutch else 1])]), slug_)


def canonical_url(base: str, *parts: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), *parts)


def basket_decode(c: Column) -> Column:
    """"name:2,other:1" to array of struct(name, qty); the last colon parts, a quantity below 1 drops the entry."""
    items = F.transform(F.split(c, ","), lambda p: F.struct(F.url_decode(F.regexp_extract(p, "^(.*):[^:]*$", 1)).alias("name"), F.regexp_extract(p, r":(\d+)[^:]*$", 1).try_cast("int").alias("qty")))
    return F.filter(items, lambda i: (i["name"] != "") & (i["qty"] >= 1))


def basket_encode(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(F.url_encode(i["name"]), F.lit(":"), i["qty"].cast("string"))), ",")


def is_cron(c: Column) -> Column:
    """Five fields of numbers, ranges, steps and lists."""
    field = r"(?:\*|\d+(?:-\d+)?)(?:/\d+)?(?:,(?:\*|\d+(?:-\d+)?)(?:/\d+)?)*"
    return F.coalesce(F.trim(c).rlike("^" + r"\s+".join([field] * 5) + "$"), F.lit(False))


# What a name on a web page is junk by, and names of shops that sell no meals, each with its reason.
PAGE_JUNK = r"(?i)\d+\s*%|à partir de|moitié prix|half price|% off|% de réduction|korting|rabais"
NON_FOOD = (
    (r"carrefour|intermarch[eé]|intermarche", "non_food:grocery"),
    (r"(proxy|express).{0,6}delhaize|delhaize.{0,6}(proxy|express)", "non_food:grocery"),
    (r"night[\s\-]?shop|day[\s\-]?night[\s\-]?soner|easy[\s\-]?day[\s\-]?shop|easy[\s\-]?market[\s\-]?shop|king[\s\-']?s[\s\-]?shop|fazi[\s\-]?shop|pardesi[\s\-]?night|shine[\s\-]?ronny", "non_food:convenience"),
    (r"librairie|press[\s\-]?shop|glory[\s\-]?press", "non_food:press"),
    (r"tom\s*&\s*co\b|une\s+vie\s+de\s+chien", "non_food:pet"),
    (r"wines?\s*[&+]\s*spirits?|wines?\s+and\s+spirits?", "non_food:wine"),
    (r"candy.{0,10}(go|shop)|(go|shop).{0,10}candy|neuhaus", "non_food:candy"),
    (r"flowers?\s*forever", "non_food:florist"),
    (r"vid[eé]o[\s\-]?box", "non_food:video"),
)


def is_page_junk(name: Column) -> Column:
    """Whether a name found on a web page is none: under four characters, pictures, or an offer."""
    s = F.trim(name)
    return (F.length(s) < 4) | s.rlike(PAGE_JUNK) | s.rlike("[\u2600-\u27bf\U00010000-\U0010ffff]")


def non_food(name: Column, slug_: Column) -> Column:
    """Why a shop sells no meals, by its name and slug; null if nothing says so. The first rule that holds decides."""
    s = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(slug_, F.lit("")))
    return F.coalesce(*[F.when(s.rlike("(?i)" + p), why) for p, why in NON_FOOD])
