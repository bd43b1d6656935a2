"""Static dimensions, as values fixed by the domain."""

from __future__ import annotations

PLATFORMS = ("uber_eats", "deliveroo", "takeaway", "direct")
AGGREGATORS = ("uber_eats", "deliveroo", "takeaway")
#: Listings and runs name one platform differently.
RUN_NAMES = {"uber_eats": "ubereats"}

# Slug, French name, Dutch name, postal codes, aliases, centroid.
COMMUNES = (
    ("anderlecht", "Anderlecht", "Anderlecht", (1070,), ("anderlecht",), (50.6619, 4.3059)),
    ("auderghem", "Auderghem", "Oudergem", (1160,), ("auderghem", "oudergem"), (50.8131, 4.4326)),
    ("berchem-sainte-agathe", "Berchem-Sainte-Agathe", "Sint-Agatha-Berchem", (1082,), ("berchem", "sint-agatha-berchem"), (50.8681, 4.2992)),
    ("bruxelles", "Bruxelles", "Brussel", (1000, 1020, 1120, 1130), ("bruxelles", "brussel", "brussels", "centre", "laeken"), (50.8503, 4.3517)),
    ("etterbeek", "Etterbeek", "Etterbeek", (1040,), ("etterbeek",), (50.8352, 4.3896)),
    ("evere", "Evere", "Evere", (1140,), ("evere",), (50.8737, 4.4023)),
    ("forest", "Forest", "Vorst", (1190,), ("forest", "vorst"), (50.8113, 4.3309)),
    ("ganshoren", "Ganshoren", "Ganshoren", (1083,), ("ganshoren",), (50.8815, 4.3149)),
    ("ixelles", "Ixelles", "Elsene", (1050,), ("ixelles", "elsene"), (50.8271, 4.3707)),
    ("jette", "Jette", "Jette", (1090,), ("jette",), (50.8875, 4.3282)),
    ("koekelberg", "Koekelberg", "Koekelberg", (1081,), ("koekelberg",), (50.8674, 4.3341)),
    ("molenbeek", "Molenbeek-Saint-Jean", "Sint-Jans-Molenbeek", (1080,), ("molenbeek", "sint-jans-molenbeek"), (50.8613, 4.3123)),
    ("saint-gilles", "Saint-Gilles", "Sint-Gillis", (1060,), ("saint-gilles", "sint-gillis"), (50.8261, 4.3454)),
    ("saint-josse", "Saint-Josse-ten-Noode", "Sint-Joost-ten-Node", (1210,), ("saint-josse", "sint-joost"), (50.8545, 4.3697)),
    ("schaerbeek", "Schaerbeek", "Schaarbeek", (1030,), ("schaerbeek", "schaarbeek"), (50.8663, 4.3787)),
    ("uccle", "Uccle", "Ukkel", (1180,), ("uccle", "ukkel"), (50.7960, 4.3556)),
    ("watermael-boitsfort", "Watermael-Boitsfort", "Watermaal-Bosvoorde", (1170,), ("watermael-boitsfort", "watermaal-bosvoorde"), (50.7997, 4.4253)),
    ("woluwe-saint-lambert", "Woluwe-Saint-Lambert", "Sint-Lambrechts-Woluwe", (1200,), ("woluwe-saint-lambert", "sint-lambrechts-woluwe"), (50.8416, 4.4338)),
    ("woluwe-saint-pierre", "Woluwe-Saint-Pierre", "Sint-Pieters-Woluwe", (1150,), ("woluwe-saint-pierre", "sint-pieters-woluwe"), (50.8202, 4.4555)),
)

# Words of a name that do not tell merchants apart.
ARTICLES = ("le", "la", "les", "l", "au", "aux", "un", "une", "de", "du", "des", "the", "a", "el", "il")
GENERIC = (
    "pizza", "pizzeria", "pizzas", "snack", "snacks", "sushi", "sushibar", "burger", "burgers", "pasta", "pastas", "tacos", "taco", "kebab", "durum",
    "pita", "friterie", "frituur", "pizzerie", "wok", "thai", "chinese", "indian", "grill", "grills", "bbq", "chicken", "poke", "bagel", "bagels",
    "sandwich", "sandwiches", "resto", "restaurant", "brasserie", "bistro", "cafe", "coffee", "boulangerie", "patisserie", "librairie", "night",
    "late", "food", "chez", "maison", "new", "royal", "star", "king", "house", "express", "city", "shop", "market", "supermarket", "traiteur", "noodle",
    "noodles", "ramen", "curry", "tandoori", "doner", "donut", "donuts", "waffle", "waffles", "gelato", "glacier", "creperie", "crepe",
)
LOCATIONS = (
    "anderlecht", "auderghem", "berchem", "etterbeek", "evere", "forest", "ganshoren", "ixelles", "elsene", "jette", "koekelberg", "molenbeek",
    "saintgilles", "sintgillis", "saintjosse", "schaerbeek", "schaarbeek", "uccle", "ukkel", "watermael", "woluwe", "laeken", "neder", "haren",
    "debrouckere", "bourse", "sablon", "flagey", "jourdan", "rogier", "schuman", "chatelain", "bascule", "ecuyer", "toison", "midi", "louise",
)
GENERIC_SLUGS = (
    "menu", "store", "stores", "restaurant", "restaurants", "resto", "order", "orders", "delivery", "checkout", "category", "categories", "shop", "be",
    "fr", "nl", "en", "home", "food", "takeaway", "deliveroo", "ubereats", "centre", "ixellesnord", "ixellessud", "stgilles", "stjosse", "stecatherine",
    "quartiereuropeen", "everenord", "everesud", "cureghem", "placeduchatelain", "boondael", "osseghem", "roodebeek",
)

# Evidence weights and bands.
WEIGHTS = {
    "name_very_high": 2.0, "name_high": 1.0, "website": 1.0, "phone": 3.0, "geo_very_close": 3.0, "geo_close": 2.0, "geo_near": 1.0, "menu_overlap": 1.0,
    "address_same": 2.5, "address_diff": -3.0, "cuisine_match": 0.5, "cuisine_conflict": -2.0, "location_conflict": -3.0, "distinctive_conflict": -2.0, "slug_match": 2.0,
}
NAME_VERY_HIGH, NAME_HIGH, NAME_IDENTITY, REMAINDER_MIN, MENU_CONFIRM = 0.97, 0.92, 0.80, 0.84, 0.15
AUTO_BAND, QUEUE_BAND, HARD_SEPARATE_M, BRANCH_M = 3.5, 1.5, 1000.0, 600.0
VENUE_SOURCES = ("uber_eats", "direct", "deliveroo_venue", "takeaway")
GEO_BANDS = ((25, 75, 200, 500), (100, 300, 700, 1500))  # venue points, zone centroids

# Cuisine keywords, the first that matches wins.
CUISINES = (
    ("Burgers", "burger|mcdonald|quick|five guys|smash|belchicken|b&w burger|black.*white"),
    ("Chicken", "kfc|chicken|poultry|poulet|belchicken"),
    ("Pizza", "pizza|domino|napoli|pizzeria"),
    ("Asian", "sushi|wok|asian|chinese|thai|vietnam|hanoi|seoul|japanese|ramen|udon|poke|bowl|bao|dim sum"),
    ("Indian", "indian|indien|curry|tikka|masala|biryani|daal|bhavan"),
    ("Mexican", "taco|burrito|mexican|mexic|nacho|guac"),
    ("Kebab", "kebab|shawarma|doner|döner"),
    ("Sandwiches", "sandwich|sub|bagel|broodje|toasties"),
    ("Healthy", "salad|salade|healthy|vegan|green|bowl|acai|oakberry|juice"),
    ("Grocery", "carrefour|delhaize|colruyt|supermarkt|supermarché|grocery"),
    ("Italian", "italian|pasta|risotto|trattoria|osteria|gelato"),
    ("Belgian", "friterie|frituur|waffle|gaufre|belgian|frites"),
)
# Words that a menu title's key leaves out.
TITLE_STOPWORDS = (
    "menu", "met", "avec", "with", "de", "het", "le", "la", "les", "du", "des", "een", "our", "nos", "maison", "homemade", "special", "speciale",
    "au", "aux", "et", "en", "and", "of", "al", "con", "bij", "op", "van",
)
# Order links to these are no channel of one's own.
COVERED = ("ubereats.com", "deliveroo.be", "deliveroo.com", "deliveroo.co", "takeaway.com", "pizza.be", "just-eat", "justeat", "lieferando", "thuisbezorgd", "wolt.com", "foodpanda")
SOURCE_PRIORITY = {"website": 3, "google_maps": 2, "fsq": 1, "osm": 0}
