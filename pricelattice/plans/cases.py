"""Case tables for what the driver's tables do not hold: promotions, hours, links, pages, payloads."""

from __future__ import annotations

import json

PROMOTIONS = [(k, t) for k, t in enumerate((
    "Free delivery", "€0 delivery on orders over €15", "Livraison offerte dès 20 €", "Gratis levering vanaf €12,50", "Kostenlose Lieferung ab 10", "Buy 1, get 1 free", "1 acheté = 1 offert", "2 for 1",
    "Article offert dès 25€", "Add a free item (min. €30)", "20% off orders over €20", "-10 %", "15 % de réduction (min: 18 €)", "Save €5", "Économisez 3,50 €", "Remise de 4 € à partir de 20 €", "Spend €25, get a treat", "Zahle 15 €, spare später",
    "Besteed meer", "Hello there", "Top rated", "Get 1 free with orders €10 +", "Dépense plus", "kaufe 1 erhalte 1 gratis",
))]

_WEEK = {"mon": [["11:00", "14:30"], ["18:00", "22:30"]], "tue": ["11:00", "22:30"], "fri": [["18:00", "02:00"]], "sat": [], "sun": [["12:00"]]}
HOURS = [
    (0, json.dumps(_WEEK), "2024-06-03 12:00:00", "open", "14:30", None),
    (1, json.dumps(_WEEK), "2024-06-03 16:00:00", "closed", None, "18:00"),
    (2, json.dumps(_WEEK), "2024-06-03 23:00:00", "closed", None, "tomorrow 11:00"),
    (3, json.dumps(_WEEK), "2024-06-04 22:30:00", "closed", None, "18:00"),
    (4, json.dumps(_WEEK), "2024-06-07 23:30:00", "open", "02:00", None),
    (5, json.dumps(_WEEK), "2024-06-07 01:00:00", "open", "02:00", None),
    (6, json.dumps(_WEEK), "2024-06-07 10:00:00", "closed", None, "18:00"),
    (7, json.dumps(_WEEK), "2024-06-09 13:00:00", "closed", None, "tomorrow 11:00"),
    (8, json.dumps({"wed": []}), "2024-06-05 13:00:00", "closed", None, None),
    (9, None, "2024-06-05 13:00:00", "unknown", None, None),
]

GEOHASHES = [("u4pruydqqvj", 57.6491, 10.4074), ("ezs42", 42.605, -5.603), ("u151", 50.8887, 4.3945), ("s", 22.5, 22.5)]
GEOHASHES = [(c, round(a, 4), round(b, 4)) for c, a, b in GEOHASHES]

NAMES = [
    (0, "Burger King - Ixelles", "burgerking", "burger", False),
    (1, "Café Barakah Halal", "cafebarakah", "cafe", False),
    (2, "Le Pain Quotidien Bruxelles", "lepainquotidien", "pain", False),
    (3, "Environ 25 min", "environ25min", "environ", True),
    (4, "-10 %", "10", "10", True),
    (5, "Pizza Hut", "pizzahut", "pizza", False),
    (6, "L'Ardoise", "lardoise", "ardoise", False),
    (7, "1 plat acheté = 1 plat offert", "1platachete1platoffert", "1", True),
]

LINKS = [
    (0, None, "02 555 11 22", "phone", False), (1, None, None, "website", False), (2, "https://burger-palace.sq-menu.com/x", None, "ordering", False), (3, "https://www.sq-menu.com/ordering/restaurant/menu", None, "menu", False),
    (4, "https://www.sq-menu.com/api/fb/abc", None, "ordering", False), (5, "https://www.quick.be/fr/menu", None, "website", False), (6, "https://shop.odoo.com/pos-self/3", None, "ordering", False), (7, "https://example.be/carte", None, "menu", False),
    (8, "https://example.be/contact", None, "website", True), (9, "https://www.ubereats.com/be/store/x", None, "website", True), (10, "https://bit.ly/abc", None, "website", True),
]

COMMUNES = [(0, "1050", None, "ixelles"), (1, "9999", "Elsene", "ixelles"), (2, None, "Quartier Flagey, Ixelles", "ixelles"), (3, "x", "nowhere", None), (4, "1020", "Uccle", "bruxelles"), (5, None, " UKKEL ", "uccle"), (6, None, None, None)]

_LD = {"@type": "Restaurant", "name": "Chez Nous", "telephone": "02 555 11 22", "servesCuisine": "Belgian", "geo": {"latitude": 50.84, "longitude": 4.36}, "address": {"streetAddress": "Rue Haute 12", "postalCode": "1000", "addressLocality": "Bruxelles"}}
PAGES = [(0, f'<html><script type="application/ld+json">{json.dumps(_LD)}</script></html>'), (1, "<html><p>nothing</p></html>"), (2, '<script type="application/ld+json">{"@type":"WebSite","name":"x"}</script>'), (3, None)]

_MENU = {"@type": "Menu", "hasMenuSection": [{"@type": "MenuSection", "name": "Pizza", "hasMenuItem": [{"@type": "MenuItem", "name": n, "offers": {"price": p}} for n, p in (("Margherita", "9,50"), ("Regina", 11), ("Calzone", "12.00"))]}]}
MENU_PAGES = [(0, f'<script type="application/ld+json">{json.dumps(_MENU)}</script>'), (1, "<h2>Pasta</h2><div><b>Carbonara</b><span>12,50</span></div><div><b>Pesto</b><span>€ 10,00</span></div>"), (2, "<p>closed</p>")]

PAYLOADS = [
    (0, "products", json.dumps({"categories": [{"name": "Burgers", "products": [{"name": " Classic ", "price": 9.5, "description": "beef"}, {"name": "", "price": 1}, {"name": "Odd", "price": "x"}]}]})),
    (1, "items", json.dumps({"categories": [{"name": "Drinks", "items": [{"name": "Cola", "price": 250}]}]})),
    (2, "store", json.dumps({"data": {"catalogSectionsMap": {"u": [{"payload": {"standardItemsPayload": {"title": {"text": "Tacos"}, "catalogItems": [{"title": "Taco XL", "price": 1150}, {"title": "Free sauce"}, {"title": ""}]}}}]}}})),
    (3, "list", json.dumps({"result": [{"name": "Soup", "list_price": 4.2, "categ_id": [3, "Starters"]}, {"name": "Bread", "list_price": 1.0, "categ_id": False}]})),
    (4, "pos", json.dumps({"templates": [{"name": "Wok", "list_price": 12.0, "pos_categ_ids": [7]}], "categories": [{"id": 7, "name": "Mains"}]})),
    (5, "sections", json.dumps({"sections": [{"heading": "Desserts", "items": [{"title": "Waffle", "price": "€ 6,50"}]}]})),
]

MERCHANT_SCHEMA = "id string, name string, website string, phone string, lat double, lng double, geo_source string, cuisine string, street_address string, postal_code string, created_at string, slugs array<string>, menu array<string>"
MERCHANTS = [
    ("a1", "Pizza Vito", "https://vito.be", "02 555 11 22", 50.8400, 4.3600, "uber_eats", "Pizza", "Rue Haute 12", "1000", "2024-01-01", ["pizza-vito"], ["margherita", "regina", "calzone"]),
    ("a2", "Pizza Vito - Bruxelles", None, "+32 2 555 11 22", 50.8401, 4.3600, "takeaway", "Pizza", "12 Rue Haute", "1000", "2024-01-02", ["pizza-vito-bruxelles"], ["margherita", "regina", "calzone"]),
    ("b1", "Pizza Mio", None, None, 50.8402, 4.3601, "uber_eats", "Pizza", "Rue Haute 14", "1000", "2024-01-03", [], []),
    ("c1", "Quick Bourse", "https://quick.be", None, 50.8480, 4.3500, "uber_eats", "Burgers", None, None, "2024-01-04", [], []),
    ("c2", "Quick Flagey", "https://www.quick.be/fr", None, 50.8277, 4.3722, "takeaway", "Burgers", None, None, "2024-01-05", [], []),
    ("d1", "Wok & Go", None, "02 444 00 00", 50.8500, 4.3400, "uber_eats", "Asian", "Place Rouppe 3", "1000", "2024-01-06", [], []),
    ("d2", "China Wok", None, "02 444 00 00", 50.8500, 4.3400, "takeaway", "Chinese", "Place Rouppe 3", "1000", "2024-01-07", [], []),
]

_C = "array<struct<name:string,url:string,lat:double,lng:double,cuisine:string>>"
SEARCH_SCHEMA = f"search_id int, name string, lat double, lng double, cuisine string, missing_platform string, blocked boolean, candidates {_C}"
SEARCHES = [
    (0, "Pizza Vito", 50.84, 4.36, "Pizza", "takeaway", True, []),
    (1, "Pizza Vito", 50.84, 4.36, "Pizza", "takeaway", False, []),
    (2, "Pizza Vito", 50.84, 4.36, "Pizza", "takeaway", False, [("Pizza Vito", "u1", 50.8401, 4.36, "Pizza")]),
    (3, "Pizza Vito", 50.84, 4.36, "Pizza", "takeaway", False, [("Sushi Bar", "u2", 50.84, 4.36, "Sushi"), ("Pizza Vito", "u3", 50.84, 4.3601, None)]),
    (4, "Pizza Vito", 50.84, 4.36, "Pizza", "takeaway", False, [("Sushi Bar", "u2", 50.84, 4.36, "Sushi")]),
    (5, "Pizza Vito", 50.84, 4.36, None, "deliveroo", False, [("Burger Town", "u4", 50.843, 4.36, None)]),
    (6, "Pizza Vito", None, None, None, "takeaway", False, [("Pizza Vito", "u5", 50.8, 4.3, None)]),
    (7, "Pizza Vito", 50.84, 4.36, None, "takeaway", False, [("Pizza Vito", "u6", 50.9, 4.36, None)]),
]

KNOWN = [(1, "Burger King", "https://burgerking.be"), (2, "Le Pain Quotidien - Sablon", None), (3, "Café Olé", "https://www.ole.be"), (4, "Wok House", None)]
INCOMING = [(10, "Burger King", None), (11, "BURGER KING", None), (12, "Anything", "http://ole.be/menu"), (13, "Burger King - Ixelles", None), (14, "Le Pain Quotidien", None), (15, "Cafe Ole", None), (16, "Nobody", None), (17, "-10 %", None)]

STORES = [
    (0, json.dumps({"fareInfo": {"minimumOrder": 1500}, "phoneNumber": " 02 1 ", "location": {"address": {"streetAddress": "Rue A 1", "postalCode": "1000"}}, "heroImageUrls": [{"url": "h"}]})),
    (1, json.dumps({"minimumOrder": 0, "meta": {"minSpend": 990}, "contactInfo": {"phone": "x"}, "location": {"streetAddress": "B 2", "zip": "1050"}, "imageUrl": "i"})),
    (2, json.dumps({"location": {"address": "C 3"}})),
]
