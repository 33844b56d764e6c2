"""Word lists, tables and patterns that results depend on."""

# Legal-form words dropped at either end of a business name.
LEGAL_WORDS = "inc incorporated corp corporation co company llc ltd limited plc llp pvt private sarl sasu srl gmbh ag sa sas eurl".split()

# English stop words.
STOP_WORDS = """
the a an and or of for in on at to by with from as is was are were be been being have has had do does did will would
could should may might can shall this that these those it its he she they we you i
""".split()

# Frequent words before a state name that are no cities.
NOT_CITIES = """
road street st nagar colony sector city town township county district distt dist village cdp east west north south new
the and of no floor block near opp area main cross lane avenue ave rd dr drive unit suite apt null
""".split()

# States by country, code and name.
STATES = {
    "us": {
        "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut",
        "de": "delaware", "dc": "district of columbia", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho",
        "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine",
        "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri",
        "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico",
        "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon",
        "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas",
        "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
    },
    "india": {
        "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ct": "chhattisgarh",
        "ga": "goa", "gj": "gujarat", "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala",
        "mp": "madhya pradesh", "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland",
        "od": "odisha", "or": "orissa", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu", "tg": "telangana",
        "ts": "telangana", "tr": "tripura", "up": "uttar pradesh", "uk": "uttarakhand", "ut": "uttarakhand", "wb": "west bengal",
        "dl": "delhi", "jk": "jammu and kashmir", "ch": "chandigarh", "py": "puducherry", "la": "ladakh",
        "dn": "dadra and nagar haveli", "ld": "lakshadweep", "an": "andaman and nicobar islands",
    },
}
MORE_STATE_NAMES = ("jammu kashmir",)
# Digits of a postal code by country; where a country's reference addresses write states as codes, else as names.
POSTAL_DIGITS = {"us": 5, "india": 6}
STATES_AS_CODES = ("us",)

# Skeleton patterns and digraphs, applied in this order.
SKELETON_LEGAL = r"^(?:p+i*r+a*i+(?:v|bh?)[a-z]*|l+i+m+i+[tr]+[a-z]*|pvt|ltd)$"
SKELETON_SHORT = r"^p+r+a+$"
DIGRAPHS = (("ph", "f"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("sh", "s"), ("ch", "c"), ("w", "v"))

# Letters of the Indic blocks by their place in the block; the blocks share one layout.
INDIC_BLOCKS = range(0x0900, 0x0D80, 0x80)
INDIC = {
    0x01: "n", 0x02: "n", 0x03: "h", 0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "r", 0x0C: "l", 0x0D: "e",
    0x0E: "e", 0x0F: "ee", 0x10: "ai", 0x11: "on", 0x12: "o", 0x13: "oo", 0x14: "au", 0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng",
    0x1A: "c", 0x1B: "ch", 0x1C: "j", 0x1D: "jh", 0x1E: "ny", 0x1F: "tt", 0x20: "tth", 0x21: "dd", 0x22: "ddh", 0x23: "nn", 0x24: "t", 0x25: "th",
    0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "nnn", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "rr",
    0x32: "l", 0x33: "ll", 0x34: "lll", 0x35: "v", 0x36: "sh", 0x37: "ss", 0x38: "s", 0x39: "h", 0x3C: "", 0x3D: "", 0x3E: "aa", 0x3F: "i",
    0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "r", 0x44: "rr", 0x45: "e", 0x46: "e", 0x47: "ee", 0x48: "ai", 0x49: "on", 0x4A: "o", 0x4B: "oo",
    0x4C: "au", 0x4D: "",
}
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "ng"}
