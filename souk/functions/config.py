"""Thresholds and fixed vocabularies. The values in the blocks marked fixed must stay as they are for results to hold."""

from __future__ import annotations

from dataclasses import dataclass, field


# The numbers of gates, margins and selection.


@dataclass(frozen=True)
class SupplierGates:
    max_shipping_days: int = 15
    require_target_market: bool = False
    require_shipping_policy: bool = False
    require_return_policy: bool = False
    require_known_shipping: bool = False
    require_dispatch_in_allowed: bool = False
    minimum_data_completeness_pct: float = 20


@dataclass(frozen=True)
class ProductGates:
    max_shipping_days: int = 15
    require_known_supplier_price: bool = True
    require_image: bool = True
    require_in_stock: bool = True


@dataclass(frozen=True)
class Margin:
    minimum_margin_pct: float = 40
    target_margin_pct: float = 55
    payment_fee_pct: float = 3
    platform_fee_pct: float = 2
    return_allowance_pct: float = 5
    estimate_shipping: bool = True
    assumed_shipping_pct: float = 15
    mode: str = "rrp"
    rrp_discount_pct: float = 0
    markup_multiple: float = 3.0
    uncompetitive_over_rrp: float = 1.3

    @property
    def fee_rate(self) -> float:
        return (self.payment_fee_pct + self.platform_fee_pct + self.return_allowance_pct) / 100


def _checked(weights: dict[str, float]) -> dict[str, float]:
    if abs(sum(weights.values()) - 100) > 1e-9:
        raise ValueError("weights must add up to 100")
    return weights


@dataclass(frozen=True)
class Scoring:
    weights: dict[str, float]
    reject_below: float
    accept_from: float | None

    def __post_init__(self) -> None:
        _checked(self.weights)


# Weights and thresholds.
SUPPLIER_SCORING = Scoring({"market_coverage": 20, "shipping_speed": 20, "dispatch_proximity": 15, "data_completeness": 10, "return_policy": 10, "shipping_policy": 10, "rating": 5, "catalog_depth": 5, "low_friction": 5}, 60, 75)
PRODUCT_SCORING = Scoring({"problem_solved": 20, "margin_potential": 20, "shipping": 15, "content_potential": 15, "differentiation": 10, "return_risk": 10, "data_quality": 5, "supplier_strength": 5}, 45, 55)


@dataclass(frozen=True)
class Selection:
    total_min: int = 18
    total_max: int = 40
    per_collection_min: int = 6
    per_collection_max: int = 10
    max_supplier_share_pct: float = 30
    max_concept: int = 2

    @property
    def per_supplier_max(self) -> int:
        return max(1, int(self.total_max * self.max_supplier_share_pct / 100))


@dataclass(frozen=True)
class Config:
    markets: tuple[str, ...] = ("REGION_0", "REGION_1", "REGION_2")
    dispatch_allowed: tuple[str, ...] = ("REGION_0", "REGION_1", "REGION_2")
    supplier_gates: SupplierGates = field(default_factory=SupplierGates)
    product_gates: ProductGates = field(default_factory=ProductGates)
    margin: Margin = field(default_factory=Margin)
    supplier_scoring: Scoring = SUPPLIER_SCORING
    product_scoring: Scoring = PRODUCT_SCORING
    selection: Selection = field(default_factory=Selection)
    minimum_confidence: float = 0.70


# Collections, keywords and category fragments, in order of precedence.
KITCHEN, DINING, COMFORT, BATHROOM, CATCH_ALL = "Kitchen Convenience", "Dining", "Home Comfort", "Bathroom", "Practical Finds"
KEYWORDS = {
    KITCHEN: ("kitchen", "cook", "cooking", "food", "meal", "chop", "peel", "slice", "grater", "utensil", "spatula", "whisk", "sink", "storage jar", "spice", "countertop", "baking", "pot", "pan", "colander", "strainer", "cutting board", "knife", "container", "jar", "gadget", "apron", "defrost"),
    DINING: ("plate", "bowl", "dish", "platter", "cutlery", "flatware", "glass", "mug", "cup", "saucer", "teapot", "tableware", "dinnerware", "serveware", "tablecloth", "napkin", "placemat", "carafe", "decanter", "tumbler", "coaster", "serving", "trivet", "teller", "schale", "besteck", "piatto", "ciotola", "posate", "assiette", "plato", "cubiertos", "bicchiere", "vassoio", "geschirr"),
    COMFORT: ("bedroom", "bed", "pillow", "blanket", "throw", "sofa", "couch", "living room", "cushion", "lamp", "light", "lighting", "cozy", "comfort", "relax", "curtain", "rug", "candle", "diffuser", "slippers", "warm"),
    BATHROOM: ("bathroom", "bath mat", "bath rug", "bath towel", "hand towel", "shower", "toilet", "soap dispenser", "soap dish", "toothbrush", "towel rail", "towel rack", "bathrobe", "shower curtain", "basin", "vanity", "loofah", "hammam", "pestemal", "toiletry", "razor", "washcloth", "badezimmer", "handtuch", "bagno", "asciugamano", "baño", "salle de bain"),
}
CATEGORY_HINTS = (("kitchen", KITCHEN), ("cookware", KITCHEN), ("dining", DINING), ("tableware", DINING), ("dinnerware", DINING), ("bedroom", COMFORT), ("bedding", COMFORT), ("living room", COMFORT), ("lighting", COMFORT), ("home decor", COMFORT), ("bath", BATHROOM), ("bathroom", BATHROOM))

# Risk patterns, and which reason they lead to.
RISKS = (
    ("HEATING", r"\b(heater|heating|electric blanket|hot plate|kettle|toaster|iron)\b"),
    ("ELECTRICAL", r"\b(plug|adapter|charger|led|wired|voltage|220v|110v|electric)\b"),
    ("BATTERY", r"\b(battery|batteries|rechargeable|li-ion|lithium)\b"),
    ("FOOD_CONTACT", r"\b(food[- ]?grade|food contact|drinking|bpa|silicone mold|straw)\b"),
    ("MEDICAL", r"\b(medical|therap|cure|treatment|posture correct|anti[- ]?bacterial)\b"),
    ("FRAGILE_GLASS", r"\b(glass|crystal|ceramic|porcelain)\b"),
    ("TRADEMARK", r"\b(disney|marvel|nike|adidas|apple|lego|gucci|super\s?mario|nintendo|spider[- ]?man|batman|superman|pok[eé]mon|hello\s?kitty|harry\s?potter|star\s?wars|minecraft|barbie|frozen elsa|paw\s?patrol|peppa\s?pig)\b"),
    ("COMPLEX_SIZING", r"\b(size chart|us size|eu size|fits|clothing|apparel|shoe)\b"),
)
COMPLIANCE = ("HEATING", "ELECTRICAL", "BATTERY", "FOOD_CONTACT", "MEDICAL", "TRADEMARK")
REFUND = ("FRAGILE_GLASS", "COMPLEX_SIZING")
PROBLEM_WORDS = r"\b(solve|solves|easy|quick|save|saves|organi[sz]e|reduce|prevent|no more|effortless)\b"

# What is out of scope. Lookaheads spare durable accessories.
EXCLUDED = (
    r"\b(olive oil|extra virgin|extra vergine|olivi|olio|aceite de oliva|cooking oil|vinegar|honey|jam|marmalade|spice|seasoning|tea|coffee beans|chocolate|snack|edible|foodstuff)\b",
    r"\b(essential oil|huile essentielle|fragrance oil|perfume oil|body oil|massage oil|lotion|body cream|face cream|hand cream|body butter|shampoo|hair conditioner|cologne|deodorant|sunscreen|sunblock|lip balm|lipstick|bath bomb|bath salt|shower gel|body wash|balm)\b",
    r"\bcosmetic",
    r"\bmoisturi[sz]",
    r"\bskin ?care\b",
    r"\bperfume\b(?!\s*bottle)",
    r"\bsoap\b(?!\s*(?:dispenser|holder|dish|tray|pump|stand|box|rack))",
    r"\b(wax melts?|incense|incenso|incienso|encens|reed diffusers?|diffuser refill|room sprays?|air freshener|potpourri|pot-pourri|scented sachets?)\b",
    r"\bcandles?\b(?!\s*(?:holder|stick|lantern|plate|tray|stand|jar|warmer|snuffer|box|making))",
    r"\b(kerzen?|bougies?)\b",
    r"\b(tealights?|teelichter?|duftkerze|duft-?teelicht)\w*",
    r"\b(insect repellent|insect spray|insecticide|pesticide|repellent|moustique|chasse[- ]?insect|mosquito repellent|anti[- ]?mosquito)\b",
    r"\b(refill|replacement only|replacement part|trigger replacement|spare part|cartridge only|remplacement)\b",
    r"\b(zweite wahl|b-?ware|b-?grade|b-?stock|factory second|2nd choice|imperfect|slight defect)\b",
    r"mit\s+(kleinen\s+)?makeln",
    r"\b(crucifix|kreuz|rosary|nativity|krippe|\bjesus\b|holy spirit|bethlehem|prayer|religious icon)\b",
    r"\b(necklace|halskette|bracelet|earrings?|pendant|schmuck|jewell?ery|\bring\b(?! holder)|brooch)\b",
    r"\b(christmas|weihnacht|xmas|advent|easter|oster|halloween|nativity)\w*",
)

# Materials in order of precedence.
MATERIALS = (
    (r"stainless steel|edelstahl|acier inoxydable", "Stainless steel"),
    (r"\btitanium|titan\b", "Titanium"),
    (r"\bcopper|kupfer|cuivre|rame\b", "Copper"),
    (r"\bbrass|messing|laiton|ottone\b", "Brass"),
    (r"olive ?wood|olivenholz|legno d'ulivo|bois d'olivier|ulivo", "Olive wood"),
    (r"\boak|eiche|chêne|rovere\b", "Oak"),
    (r"\bwalnut|nussbaum|noyer|noce\b", "Walnut"),
    (r"\bbamboo|bambus|bambou|bambù\b", "Bamboo"),
    (r"\bwood|holz|bois|legno|madera|drewn\b", "Wood"),
    (r"\bceramic|keramik|céramique|ceramica|cerámica\b", "Ceramic"),
    (r"\bporcelain|porzellan|porcelaine|porcellana\b", "Porcelain"),
    (r"\bglass|glas|verre|vetro|cristal\b", "Glass"),
    (r"\bleather|leder|cuir|cuero|pelle\b", "Leather"),
    (r"\bcotton|baumwolle|coton|cotone|algodón\b", "Cotton"),
    (r"\blinen|leinen|\blin\b|lino\b", "Linen"),
    (r"\bwool|wolle|laine|lana\b", "Wool"),
    (r"\bmetal|metall|métal|metallo\b", "Metal"),
)
DIMENSION = r"(?iU)(\bØ?\s?\d{1,3}(?:[.,]\d)?\s?[x×]\s?\d{1,3}(?:[.,]\d)?(?:\s?[x×]\s?\d{1,3}(?:[.,]\d)?)?\s?(?:cm|mm|m\b))"
WEIGHT = r"(?iU)(\b\d{1,4}(?:[.,]\d{1,3})?\s?(?:g|kg|gr|gramm|grammes?)\b)"
#: Codes of the target markets and of the two other countries that sources name by code, and their names.
MARKET_CODES = {"ES": "Spain", "PT": "Portugal", "FR": "France", "DE": "Germany", "IT": "Italy", "AT": "Austria", "BE": "Belgium", "NL": "Netherlands", "IE": "Ireland", "US": "United States", "GB": "United Kingdom", "CN": "China"}
#: Schemes whose addresses begin with two slashes even without a host; names of what must not be kept.
ROOTED_SCHEMES = ("ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services")
SECRET = r"(authorization|cookie|set-cookie|token|password|secret|api[-_]?key|x-auth)"
TYPE_BY_COLLECTION = {KITCHEN: "Kitchen & Dining", COMFORT: "Home Décor", CATCH_ALL: "Home Storage & Organization"}

# Country names, url parameters, boolean words, stop words.
COUNTRIES = {
    "usa": "United States", "us": "United States", "u.s.": "United States", "united states of america": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "great britain": "United Kingdom", "deutschland": "Germany",
    "espana": "Spain", "españa": "Spain", "italia": "Italy", "nederland": "Netherlands", "the netherlands": "Netherlands",
    "holland": "Netherlands", "osterreich": "Austria", "österreich": "Austria", "belgie": "Belgium", "belgique": "Belgium",
    "eire": "Ireland", "czechia": "Czech Republic", "czech republic": "Czech Republic",
}
TRACKING_PREFIXES = ("utm_", "mc_", "pk_")
TRACKING_NAMES = ("gclid", "fbclid", "ref", "referrer", "source", "_ga", "yclid", "msclkid")
TRUE_WORDS = ("true", "yes", "y", "1", "available", "in stock", "instock", "enabled", "active")
FALSE_WORDS = ("false", "no", "n", "0", "unavailable", "out of stock", "disabled", "inactive")
CONCEPT_STOPWORDS = ("the", "a", "an", "for", "with", "and", "of", "set", "pcs", "pack", "new", "premium", "steel", "stainless", "plastic", "silicone", "kitchen", "home", "portable", "mini")
FALLBACK_RATES = {"EUR": 1.0, "USD": 0.92, "GBP": 1.17, "CHF": 1.05, "AUD": 0.60, "CAD": 0.68, "NZD": 0.56, "SGD": 0.69, "HKD": 0.118, "JPY": 0.0060, "CNY": 0.127, "INR": 0.011, "AED": 0.25, "SEK": 0.088, "NOK": 0.086, "DKK": 0.134, "PLN": 0.23, "CZK": 0.040, "HUF": 0.0026, "RON": 0.20, "BGN": 0.51, "TRY": 0.028, "ZAR": 0.050, "MXN": 0.052, "BRL": 0.17}
BLOCKING = ("Gate Failed", "Scored Rejected", "Manually Blocked", "Inactive")
MANUAL_STATUSES = ("Manually Approved", "Manually Rejected")
