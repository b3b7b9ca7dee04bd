"""Fixed values of the listing domain: rates, ranges, word lists and spellings. None is learned."""

# Currency to AZN.
RATES = {"AZN": 1.0, "USD": 1.70, "EUR": 1.97, "RUB": 0.02}
# Scope and plausible ranges.
KEEP_CATEGORIES = ["Yeni tikili", "Köhnə tikili", "Həyət evi/Bağ evi"]
PRICE_RANGE = (5_000.0, 15_000_000.0)
AREA_RANGE = (10.0, 3_000.0)
PRICE_PER_M2_RANGE = (30.0, 25_000.0)
ROOMS_RANGE = (1.0, 20.0)
MAX_TOTAL_FLOORS = 60.0
LAT_RANGE, LNG_RANGE = (38.3, 41.95), (44.7, 50.9)
CENTER = (40.3777, 49.8920)
MAP_BOX = {"lat": (40.25, 40.65), "lng": (49.60, 50.40)}
# Words of yes/no fields, after folding.
YES = ["var", "beli", "he", "yes", "true", "1", "movcuddur", "есть", "да"]
NO = ["yox", "yoxdur", "xeyr", "no", "false", "0", "нет"]
YES_STEMS = ["temir", "cixaris", "kupca", "ipoteka", "ipotek"]
# Columns that restate the price, name a person or a page, or describe the advertisement.
LEAKAGE = ["unit_price", "total_price"]
IDENTIFIERS = ["id", "item_id", "url", "link", "owner_name", "owner_title", "owner", "shop_name", "shop_title", "shop", "address", "phone", "contact"]
META = ["vip", "featured", "products_label", "updated", "created", "date", "views", "city_when", "day_x", "day_y", "hour_x", "hour_y", "datetime_scrape_y", "currency_y"]
# Canonical column: accepted spellings, the preferred first.
ALIASES = {
    "price": ["price", "qiymet"],
    "currency": ["currency", "currency_x", "valyuta"],
    "listing_key": ["estate_rel_url_x", "estate_rel_url", "item_url", "item_id", "listing_id"],
    "scraped_at": ["datetime_scrape_x", "datetime_scrape", "scraped_at"],
    "extra_info": ["extra_info"],
    "area_raw": ["sahe", "area", "area_m2", "sahe_m2"],
    "rooms_raw": ["otaq_sayi", "rooms", "room_count", "otaq"],
    "floor_raw": ["mertebe", "floor"],
    "land_raw": ["torpaq_sahesi", "land_area", "land"],
    "lat": ["lat", "latitude"],
    "lng": ["lng", "lon", "long", "longitude"],
    "location": ["location", "district", "rayon", "qesebe"],
    "city": ["city", "seher"],
    "building_type": ["binanin_novu", "building_type"],
    "category": ["kateqoriya", "category"],
    "repair_raw": ["temir", "repair"],
    "mortgage_raw": ["ipoteka", "mortgage"],
    "bill_of_sale_raw": ["cixaris", "bill_of_sale", "kupca"],
    "description": ["description", "tesvir", "melumat"],
    "attributes": ["attributes", "attrs"],
}
# Description keywords, after folding.
KEYWORDS = {
    "kw_metro": ["metro", "метро"],
    "kw_sea": ["deniz", "море", "sea view"],
    "kw_furnished": ["mebel", "esyali", "мебел"],
    "kw_urgent": ["tecili", "срочно"],
    "kw_euro_reno": ["avro temir", "euro temir", "евроремонт", "avrotemir"],
    "kw_parking": ["qaraj", "parking", "dayanacaq", "паркинг"],
}
# Feature roles.
NUMERIC = ["area_m2", "log_area", "rooms", "area_per_room", "floor", "total_floors", "floor_ratio", "is_top_floor", "is_first_floor", "land_area_sot", "has_land", "lat", "lng", "dist_center_km", "desc_log_len"]
BINARY = ["repair", "mortgage", "bill_of_sale", *KEYWORDS]
CATEGORICAL = ["category", "building_type", "city", "district", "location"]
MULTILABEL = ["tags"]
INDICATORS = ["rooms", "floor", "total_floors", "lat", "repair"]
MIN_COUNT, MAX_LEVELS, MAX_LABELS = 20, 60, 200
# Split, bands, selection grids.
VAL_SIZE, TEST_SIZE, STRATA, FOLDS, SEED = 0.15, 0.15, 10, 5, 42
PRICE_BANDS = [75_000.0, 125_000.0, 200_000.0, 350_000.0, 600_000.0]
MAX_DISTRICTS, MIN_DISTRICT_ROWS = 12, 30
RIDGE_ALPHAS = [1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0]
# Serving: labels of categories, kinds of locations.
CATEGORY_LABELS = {"yeni tikili": "New building", "kohne tikili": "Old building", "heyet evi/bag evi": "House / villa"}
LOCATION_KINDS = {"m.": "metro", "q.": "settlement", "r.": "district"}
