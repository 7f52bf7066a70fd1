"""Fixed values of the category, situation and need rules. They are data for the plans and can be replaced by a caller's own."""

from __future__ import annotations

# Lifestyle categories and the merchant codes of each, in priority order; the first list with a code wins.
LIFESTYLE_CODES = (
    ("excursion", ("79996", "5947", "7999", "7991", "4112", "4722", "4789", "7922", "9399", "5812", "89999", "7299", "5944")),
    ("spa", ("7298", "7230", "5812", "8099", "8050", "8011", "5995", "5814", "5977", "8041", "5976", "7399", "5211", "5331")),
    ("training", ("7941",)),
    ("paidTickets", ("3991",)),
    ("concerts", ("7922", "3990", "7299", "5812")),
    ("exhibitions", ("7922", "7991", "3990", "9399", "7999", "7991", "5945", "5462", "5441", "7996", "8299", "5947", "5971",
                     "8220", "7399", "4722")),
)
# Categories that are scored; some have no merchant codes and can only be lifted by tags.
LIFESTYLE_CATEGORIES = (
    "autoRent", "excursion", "tourOrHotel", "eventForeign", "spa", "event", "training", "lecture", "paidTickets",
    "concerts", "exhibitions",
)
EXHIBITION_TAGS = ("10067", "10095", "10564", "21929", "21928", "33936", "21936", "21930", "21937", "21934")
# Tag codes per lifestyle category.
LIFESTYLE_TAGS = (
    ("autoRent", ("22631",)),
    ("tourOrHotel", ("10582", "10583")),
    ("eventForeign", ("39602",)),
    ("event", ("10138", "33532", "10175", "10144", "20082", "20116")),
    ("lecture", ("33539",)),
    ("exhibitions", EXHIBITION_TAGS),
)
# Weights of amount share, count share and regularity; tag step, tag ceiling and close-race gap in percent.
WEIGHTS = (0.5, 0.3, 0.2)
TAG_STEP, TAG_CEILING, CLOSE_GAP = 0.05, 0.3, 10.0
PROPENSITY_WEIGHT, PROPENSITY_FLOOR = 0.1, 70.0

# Perks by merchant code.
LOUNGE_CODES = ("45882", "4722", "5814", "72999", "73999")
TAXI_CODES = ("4121", "3990", "4789", "4131", "5999", "4816", "73992", "7299", "4111")

# Life spheres in priority order; a row belongs to a sphere when its code and a keyword both hit.
SPHERES = (
    {"label": "trips",
     "codes": ("4582", "4112", "4411", "4722", "4011", "4511", "3042", "7011", "7032", "7033", "4723", "5309", "8999",
               "7277", "9399", "5999", "6300"),
     "ranges": (("3501", "3827"), ("3000", "3350")),
     "words": ("aviaperevozchik", "aeroport", "terminal_aeroport", "vokzal", "kruiz", "parom", "perevozki", "avia", "otel",
               "camping", "kemping", "lager", "tyr", "tur", "duty", "visa", "viza")},
    {"label": "sport",
     "codes": ("5655", "5940", "5941", "7941", "7997", "7911", "7277", "7999", "8299", "5331", "5661", "5699", "7011",
               "7298", "5814", "7996", "9399", "8011", "4814", "7297", "5247", "7230", "5999", "5812", "3567", "5499",
               "7032", "7914"),
     "words": ("sport", "club", "klub", "pool", "basseyn", "dance", "tansy", "massage", "massazh", "spa", "fitnes", "beaut",
               "krasot")},
    {"label": "entertainmentAndHobbies",
     "codes": ("3991", "3990", "7922", "7832", "7999", "5815", "5399", "5814", "7011", "5812", "7991", "7929", "9399",
               "8299", "8999", "7911", "7933", "7994", "5945", "5462", "5441", "5947", "5971", "8220"),
     "words": ("ticket", "bilet", "cinema", "kino", "teatr", "theater", "filarmoniya", "park", "razvlechen", "bouling",
               "bowling", "game", "igra", "muzei", "museums", "vystavki", "exhibition")},
    {"label": "health",
     "codes": ("8021", "9071", "8031", "8049", "8050", "8062", "7277", "4119", "5047", "5296", "5975", "5976", "8011",
               "8041", "8071", "8099", "8351", "8676", "5122", "5292", "5295", "5912", "7299"),
     "words": ("dentist", "dantist", "doctor", "medicine", "meditsina", "ortoped", "orthopedist", "sanatoriy", "sanatorium",
               "hospital", "bolnitsa", "atler", "apteka", "pharmacy", "analiz", "test")},
    {"label": "auto",
     "codes": ("5511", "7538", "5541", "6300", "5533", "5599", "4784", "9399", "6012", "4789", "7523"),
     "words": ("avto", "diler", "major", "rolf", "avilon", "borishof", "service", "techcenter", "diagnosti", "shinomont",
               "kuzov", "pokras", "parking", "avtodor", "strahov", "insurance", "osago", "kasko", "ingosstrakh",
               "alfastrah", "sogaz", "vsk", "renessans", "azs", "gas", "fuel", "petrol", "gasoline", "diesel", "refuel",
               "gazpromneft", "lukoil", "rosneft")},
    {"label": "pets",
     "codes": ("0742", "5995", "5912", "8011", "8999", "8062", "5411", "7299", "8099", "5992", "5331", "5945", "5814",
               "4900", "9402"),
     "words": ("zoo", "vet", "soo", "pet")},
    {"label": "cafesAndRestaurants",
     "codes": ("5812", "5499", "5814", "5411"),
     "words": ("cofe", "cafe", "kantata", "drinkit", "cofemani", "surf", "cofix", "stars", "coffee", "skuratov",
               "vostochn")},
    {"label": "purchases",
     "codes": ("3990", "5411", "5812"),
     "words": ("yandex", "lavka", "lavca", "lafka", "lafca")},
)
CINEMA_TAGS = (
    "10024", "10026", "12860", "33093", "10036", "10035", "33174", "10034", "15875", "10033", "10045", "12854", "10039",
    "33095", "33094", "10052", "10032", "10025", "10041", "10046", "10037", "10038", "10044", "10050", "10047", "10040",
    "10048", "10042", "10031", "10062", "12891", "10051", "15932", "15878", "10054", "15874", "10049", "15876", "12874",
    "15882", "29910", "15879", "32226", "10056", "32246", "33106", "15877", "32216", "12856", "32243", "33105", "14457",
    "15933", "38379", "33108", "15884", "33107", "38380", "40875", "15934", "14459",
)
FITNESS_TAGS = (
    "33538", "10139", "10967", "22486", "20127", "20120", "20092", "20098", "15852", "15854", "15865", "15861", "15856",
    "15853", "15859", "15851", "15869", "15857",
)
# Tag codes per life sphere.
SPHERE_TAGS = (
    ("entertainmentAndHobbies", CINEMA_TAGS + EXHIBITION_TAGS),
    ("health", ("10440", "11826", "10441", "27183", "33926", "10881", "11825", "27180", "33933", "10282", "22502", "15962",
                "38899", "33929", "33184", "38898")),
    ("sport", FITNESS_TAGS + ("10140",)),
    ("trips", ("10227", "33524", "10609", "10231", "10597", "10582", "10588", "10584", "10583", "10581", "10576", "10432",
               "22631", "10594", "12935", "10585", "10577", "10613", "20886", "10579", "10578", "12920", "10580", "22630",
               "10229", "12911", "22094", "12914", "12929", "12906", "22089", "12917", "12904", "22091", "10228")),
    ("auto", ("10283", "10292", "10610", "10611", "10612", "10615", "10616", "10617", "10886", "14472", "15846", "15894",
              "22230", "22231", "22232", "22233", "22234", "22235", "33182", "33505", "33511", "33516", "33517", "34204",
              "34205", "39047", "39048", "39049", "39594", "39595", "39596")),
    ("pets", ("33551", "39157", "39159")),
)
# Spheres that need a minimum of transactions before they are assigned.
GATED_SPHERES = ("sport", "health", "trips", "entertainmentAndHobbies")
# Needs whose 30-day model scores support a close race, and the sphere of each.
SPHERE_NEEDS = (
    ("trips", ("8.8.4", "8.8.5", "8.8.7")),
    ("sport", ("1.51.3",)),
    ("cafesAndRestaurants", ("7.2.1", "7.2.2", "7.50.1", "7.50.3")),
    ("pets", ("10.18.5", "10.18.6", "10.18.2")),
)
SUB_NEEDS = ("8.8.4", "8.8.7", "8.56.3", "1.51.3")

_SPA_CODES = ("7298", "7230", "5812", "8099", "8050", "8011", "5995", "5814", "5977", "8041", "5976", "7399", "5211", "5331",
              "7011", "7996", "8299", "9399", "4814", "7297", "5247", "5999", "7911", "7277", "7999", "7997")
_MEDICAL_CODES = ("4119", "5047", "5296", "5975", "5976", "8011", "8021", "8031", "8049", "8050", "8062", "8071", "8099",
                  "8351", "8676")
# Sub-situations in priority order, and the sphere each belongs to.
SUB_SITUATIONS = (
    {"label": "sport", "sphere": "trips", "codes": ("7032",), "words": ("ski",)},
    {"label": "family", "sphere": "trips", "codes": ("5651",), "words": ("family", "semia")},
    {"label": "auto", "sphere": "trips", "codes": ("7542", "7538", "7535", "7534"),
     "words": ("avto", "moyka", "cto", "sto", "pokras", "shino")},
    {"label": "beauty", "sphere": "sport", "codes": _SPA_CODES,
     "words": ("beauty", "massage", "dance", "spa", "krasot", "pool", "basse")},
    {"label": "hasFitmost", "sphere": "sport", "codes": ("7997", "8299"), "words": ("fitmost",)},
    {"label": "fitness", "sphere": "sport", "codes": ("7997", "5812", "7941", "8011", "3567", "5499", "7298", "7032", "5814"),
     "words": ("fitnes", "sport", "club")},
    {"label": "theaters", "sphere": "entertainmentAndHobbies", "codes": ("7922", "7991", "3990", "9399", "5814", "5812"),
     "words": ("theat", "teatr", "bufet")},
    {"label": "cinema", "sphere": "entertainmentAndHobbies",
     "codes": ("7832", "5814", "3991", "7922", "7011", "5812", "4899"), "words": ("kino", "cinema", "okko", "ticket")},
    {"label": "medical", "sphere": "health", "codes": _MEDICAL_CODES, "words": ("medical", "center", "medcenter")},
    {"label": "kids", "sphere": "health", "codes": _MEDICAL_CODES + ("5122", "5292", "5295"),
     "words": ("medical", "center", "medcenter", "aptek")},
    {"label": "laboratory", "sphere": "health", "codes": ("8062", "8071", "8011", "7299", "5912", "8099"),
     "words": ("laborat", "analyz")},
)
# Merchant codes read for the sub-situations. A rule's code outside this list never takes effect.
SUB_CODES = (
    "7032", "5651", "7542", "7538", "7535", "7534", "7298", "7230", "5812", "8099", "8050", "8011", "5995", "5814", "5977",
    "8041", "5976", "7399", "5211", "5331", "7011", "7996", "8299", "9399", "4814", "7297", "5247", "5999", "7911", "7277",
    "7999", "7997", "7941", "3567", "5499", "7922", "7991", "3990", "7832", "4899", "4119", "5047", "5296", "5975", "8021",
    "8031", "8049", "8062", "8071", "8351", "8676", "5122", "5292", "5295", "7299", "5912",
)
# Tag codes per sub-situation.
SUB_TAGS = (
    ("family", ("10245", "10252", "10253", "11846", "11845", "11847", "11844", "11848", "11843", "11849", "11842", "11850",
                "11841", "10251", "11840", "11837", "11839", "11836", "10250", "11838", "11835", "11834", "10249", "41621")),
    ("auto", ("10228", "22631")),
    ("fitness", FITNESS_TAGS),
    ("theaters", ("20544", "15880") + EXHIBITION_TAGS),
    ("cinema", CINEMA_TAGS),
)
# Situations without sub-situations.
FLAT_SITUATIONS = ("auto", "pets", "cafesAndRestaurants", "purchases")

# Needs per product in priority order. {house} stands for the owner's own brand prefix.
PRODUCT_NEEDS = (
    ("cooper", ("10.18.5", "10.18.6", "1.51.3", "1.51.4", "6.45.10", "1.9.1", "1.9.2", "10.19.7", "10.19.10", "8.8.4", "8.8.5",
                "8.16.15", "8.16.1", "8.59.6", "8.59.5", "7.2.1", "7.2.2", "7.12.1", "7.12.4", "7.50.1", "7.50.3", "10.18.2",
                "6.45.11", "6.44.1", "6.44.2")),
    ("{house}Health", ("10.18.5", "10.18.6", "10.18.2", "1.17.2", "1.17.6", "10.17.6")),
    ("citydrive", ("2.25.3", "2.25.4")),
    ("{house}Pravo", ("2.30.2", "2.30.3", "2.1.5", "2.25.4", "2.30.5", "1.6.1", "3.4.4", "3.15.5")),
    ("samokat", ("1.51.3", "1.54.4", "6.45.10", "6.44.1", "6.44.2", "10.19.7", "10.19.10", "8.8.4", "8.8.5", "8.56.3", "8.62.1",
                 "5.37.2", "5.38.4", "7.12.1", "7.12.4", "7.50.1", "7.50.3", "7.2.1")),
    ("okko", ("1.51.3", "8.8.4", "8.8.5", "5.37.2", "5.38.4", "8.56.3")),
    ("zvuk", ("1.51.3", "8.8.4", "8.8.5")),
    ("zls", ("1.17.2", "1.17.6", "3.4.4", "4.31.1", "3.26.4", "3.15.5", "3.5.1")),
    ("vzr", ("8.8.4", "8.8.7")),
    ("mriya", ("1.17.6", "1.17.2", "8.8.4", "8.8.5")),
    ("{house}Mobile", ("8.8.4", "8.8.5", "3.26.4")),
    ("otello", ("8.8.4", "8.8.5")),
    ("afisha", ("8.56.3",)),
    ("manzherok", ("8.8.4", "8.8.5")),
    ("lifestyleGeneral", ("2.22.4", "2.30.3", "2.30.5", "1.51.3", "1.54.4", "6.45.10", "6.44.1", "6.44.2", "10.19.10", "8.8.4",
                          "8.8.7", "8.16.15", "8.16.1", "8.59.6", "8.59.5", "8.56.3", "3.4.4", "3.15.5", "3.26.4", "2.30.2",
                          "2.1.5", "2.25.4", "2.27.1", "1.51.4", "6.45.11", "10.19.7", "5.40.2", "8.8.5", "6.42.1")),
)
# Level limits (lowest, highest) of products in the ranking.
PRODUCT_LEVELS = {"lifestyleGeneral": (4, None), "vzr": (None, 1)}

# Fixed values: (product, lowest level, highest level, needs, situation, sub-situation) in priority order.
SITUATION_RULES = (
    ("cooper", None, None, ("10.18.5", "10.18.6"), "pets", "default"),
    ("cooper", None, None, ("10.18.2",), "pets", "health"),
    ("cooper", None, None, ("1.51.3", "1.51.4"), "sport", "default"),
    ("cooper", None, None, ("6.45.10", "6.45.11", "6.44.1", "6.44.2"), "healthAndBeauty", "beauty"),
    ("cooper", None, None, ("1.9.1", "1.9.2"), "healthAndBeauty", "pharmacy"),
    ("cooper", None, None, ("10.19.7", "10.19.10"), "kids", "kids0To6"),
    ("cooper", None, None, ("8.8.4", "8.8.5"), "trips", "default"),
    ("cooper", None, None, ("8.16.15", "8.16.1", "8.59.6", "8.59.5"), "entertainmentAndHobbies", "specialShops"),
    ("cooper", None, None, ("7.2.1", "7.2.2"), "other", "shopsNotFromList"),
    ("cooper", None, None, ("7.12.1", "7.12.4", "7.50.1", "7.50.3"), "other", "cafeAndRestaurants"),
    ("cooper", None, None, ("3.4.4", "3.5.1", "3.15.5"), "realEstate", "shoppingForHouse"),
    ("{house}Health", None, None, ("10.18.5", "10.18.6", "10.18.2"), "pets", ""),
    ("{house}Health", None, None, ("1.9.1", "1.9.2"), "", "default"),
    ("{house}Health", None, None, ("1.17.2", "1.17.6"), "healthAndBeauty", "laboratory"),
    ("{house}Health", None, None, ("10.17.6",), "kids", "kids0To14"),
    ("citydrive", None, None, ("2.25.3", "2.25.4"), "auto", "carsharing"),
    ("{house}Pravo", None, None, ("2.30.2", "2.30.3", "2.1.5", "2.25.4", "2.30.5"), "auto", "fines"),
    ("{house}Pravo", None, None, ("1.6.1",), "other", "taxes"),
    ("{house}Pravo", None, None, ("3.4.4", "3.15.5"), "realEstate", "moreThan2Estates"),
    ("{house}Pravo", None, None, ("2.25.3",), "auto", "carsharing"),
    ("samokat", None, None, ("1.51.3", "1.54.4"), "sport", "default"),
    ("samokat", None, None, ("6.45.10", "6.44.1", "6.44.2"), "healthAndBeauty", "default"),
    ("samokat", None, None, ("10.19.7", "10.19.10"), "kids", "dids0To6"),
    ("samokat", None, None, ("8.8.4", "8.8.5"), "trips", "default"),
    ("samokat", None, None, ("8.56.3",), "entertainmentAndHobbies", "cinema"),
    ("samokat", None, None, ("8.62.1", "5.37.2", "5.38.4"), "entertainmentAndHobbies", "books"),
    ("samokat", None, None, ("7.12.1", "7.12.4", "7.50.1", "7.50.3"), "other", "cafeAndRestaurants"),
    ("samokat", None, None, ("7.2.1",), "default", "default"),
    ("okko", None, None, ("1.51.3",), "sport", "default"),
    ("okko", None, None, ("8.8.4", "8.8.5"), "trips", "default"),
    ("okko", None, None, ("5.37.2", "5.38.4"), "entertainmentAndHobbies", "selfeEducation"),
    ("okko", None, None, ("8.56.3",), "entertainmentAndHobbies", "cinema"),
    ("zvuk", None, None, ("1.51.3",), "sport", "default"),
    ("zvuk", None, None, ("8.8.4", "8.8.5"), "trips", "default"),
    ("zls", None, None, ("1.17.2", "1.17.6"), "healthAndBeauty", "healthInsurance"),
    ("zls", None, None, ("3.4.4",), "trips", "realEstate"),
    ("zls", None, None, ("4.31.1",), "other", "financeInsurance"),
    ("zls", None, None, ("3.26.4",), "realEstate", "houseInsurance"),
    ("zls", None, None, ("3.15.5", "3.5.1"), "realEstate", "houseRepairInsurance"),
    ("vzr", 1, 1, ("8.8.4", "8.8.7"), "trips", "vzr1Level"),
    ("mriya", None, None, ("1.17.6", "1.17.2"), "healthAndBeauty", "default"),
    ("mriya", None, None, ("8.8.4", "8.8.5"), "trips", "default"),
    ("{house}Mobile", None, None, ("8.8.4", "8.8.5"), "trips", "default"),
    ("{house}Mobile", None, None, ("3.26.4",), "realEstate", "new{House}mobileSubscriber"),
    ("otello", None, None, ("8.8.4", "8.8.5"), "trips", "hasBonuses"),
    ("afisha", 3, None, ("8.56.3",), "entertaimentAndHobbies", "tickets"),
    ("manzherok", 4, None, ("8.8.4", "8.8.5"), "trips", "default"),
    ("lifestyleGeneral", 4, None, ("2.22.4",), "auto", "interestedInBuyingCar"),
    ("lifestyleGeneral", 4, None, ("2.30.3", "2.30.5"), "auto", "carRepair"),
    ("lifestyleGeneral", 4, None, ("1.51.3", "1.54.4"), "sport", "default"),
    ("lifestyleGeneral", 4, None, ("6.45.10", "6.44.1", "6.44.2"), "healthAndBeauty", "default"),
    ("lifestyleGeneral", 4, None, ("10.19.10",), "kids", "kids0To6"),
    ("lifestyleGeneral", 4, None, ("8.8.4", "8.8.7"), "trips", "default"),
    ("lifestyleGeneral", 4, None, ("8.16.15", "8.16.1", "8.59.6"), "entertaimentAndHobbies", "specialShops"),
    ("lifestyleGeneral", 4, None, ("8.59.5",), "entertaimentAndHobbies", "sporingEvents"),
    ("lifestyleGeneral", 4, None, ("8.59.3",), "entertaimentAndHobbies", "concertsEvents"),
    ("lifestyleGeneral", 4, None, ("3.4.4.", "3.15.5", "3.26.4"), "realEstate", "householdServices"),
    ("lifestyleGeneral", 6, None, ("2.30.2", "2.1.5", "2.25.4"), "auto", "carOwners"),
    ("lifestyleGeneral", 6, None, ("2.27.1",), "auto", "taxiTransfer"),
    ("lifestyleGeneral", 6, None, ("1.51.4",), "sport", "default"),
    ("lifestyleGeneral", 6, None, ("6.45.11",), "healthAndBeauty", "spaBeautySalons"),
    ("lifestyleGeneral", 6, None, ("10.19.7",), "kids", "kids0To6"),
    ("lifestyleGeneral", 6, None, ("5.40.2",), "kids", "kids14To18"),
    ("lifestyleGeneral", 6, None, ("8.8.5",), "trips", "default"),
    ("lifestyleGeneral", 6, None, ("3.4.4",), "realEstate", "householdServices"),
    ("lifestyleGeneral", 6, None, ("8.56.3",), "entertaimentAndHobbies", "sportingEvents"),
    ("lifestyleGeneral", 6, None, ("6.42.1",), "entertaimentAndHobbies", "shoppingForClothes"),
)


def with_house(text: str, house: str) -> str:
    return text.replace("{house}", house).replace("{House}", house.capitalize())


def product_needs(house: str = "own") -> list[tuple[str, tuple[str, ...]]]:
    return [(with_house(p, house), needs) for p, needs in PRODUCT_NEEDS]


def situation_rules(house: str = "own") -> list[tuple]:
    return [(with_house(p, house), lo, hi, needs, with_house(s, house), with_house(sub, house))
            for p, lo, hi, needs, s, sub in SITUATION_RULES]
