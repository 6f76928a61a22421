"""Fixed values that results depend on: word lists, patterns and codes, in their natural order."""

# Fixed values. Legal forms, left out of a name's core.
LEGAL_FORMS = "inc incorporated llc corp corporation co company ltd limited pvt private llp plc lp pllc pc sarl sas sasu eurl sa sci snc ets ei".split()

# Fixed values. Words that say little about a business's name.
FILLER_WORDS = (
    "inc incorporated llc corp corporation co company ltd limited pvt private llp plc lp pllc pc sarl sas sasu eurl sa sci snc ets etablissements ei cie groupe group "
    "the and of services service center centre partners ms m s sri shri smt mr dr mrs"
).split()

# Fixed values. What precedes the name that a business goes by; the first one counts.
ALIAS_MARKER = r"(?i)^.*?\b(?:d/b/a|dba|doing business as|formerly known as|formerly|f/k/a|fka|trading as|t/a|also known as|a\.k\.a\.?|aka)\b:?\s*"
WEB_PARTS = r"(?i)(^[@#]+|www\.|\.(?:co\.in|com|in|net|org|fr)\b)"

# Fixed values. States of India, whose place in the list is their bit, then other names, codes, and the states of each script's block.
STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh",
    "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand",
    "West Bengal", "Andaman and Nicobar Islands", "Chandigarh", "Dadra and Nagar Haveli", "Daman and Diu", "Delhi", "Jammu and Kashmir", "Ladakh", "Lakshadweep", "Puducherry",
]
STATE_ALIASES = {"orissa": "Odisha", "pondicherry": "Puducherry", "keralam": "Kerala"}
STATE_CODES = {
    "ap": "Andhra Pradesh", "br": "Bihar", "dl": "Delhi", "gj": "Gujarat", "hr": "Haryana", "ka": "Karnataka", "kl": "Kerala", "mp": "Madhya Pradesh", "mh": "Maharashtra",
    "od": "Odisha", "or": "Odisha", "pb": "Punjab", "rj": "Rajasthan", "tn": "Tamil Nadu", "tg": "Telangana", "ts": "Telangana", "up": "Uttar Pradesh", "wb": "West Bengal",
}
SCRIPT_STATES = {
    "Devanagari": ["Maharashtra", "Delhi", "Uttar Pradesh", "Haryana", "Rajasthan", "Bihar", "Madhya Pradesh"],
    "Bengali": ["West Bengal"],
    "Gurmukhi": ["Punjab"],
    "Gujarati": ["Gujarat"],
    "Odia": ["Odisha"],
    "Tamil": ["Tamil Nadu"],
    "Telugu": ["Andhra Pradesh", "Telangana"],
    "Kannada": ["Karnataka"],
    "Malayalam": ["Kerala"],
}

# Fixed values. French departments by region, US states and their codes, and words of addresses.
FRENCH_REGIONS = {"nord": "Hauts-de-France", "gironde": "Nouvelle-Aquitaine", "loire-atlantique": "Pays de la Loire"}
US_STATES = dict(
    zip(
        (
            "alabama,alaska,arizona,arkansas,california,colorado,connecticut,delaware,florida,georgia,hawaii,idaho,illinois,indiana,iowa,kansas,kentucky,louisiana,maine,maryland,massachusetts,michigan,"
            "minnesota,mississippi,missouri,montana,nebraska,nevada,new hampshire,new jersey,new mexico,new york,north carolina,north dakota,ohio,oklahoma,oregon,pennsylvania,rhode island,south carolina,"
            "south dakota,tennessee,texas,utah,vermont,virginia,washington,west virginia,wisconsin,wyoming,district of columbia"
        ).split(","),
        "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split(),
    )
)
STREET_WORDS = {"street": "st", "road": "rd", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "court": "ct", "circle": "cir", "apartment": "apt", "suite": "ste", "floor": "fl", "number": "no"}
FRENCH_STREET_WORDS = {"bd": "boulevard", "boul": "boulevard", "av": "avenue", "all": "allee", "r": "rue"}

# Fixed values. Parts of addresses that hold numbers.
UNIT_PHRASE = r"\b(?:unit|apt|apartment|suite|ste|flat|floor|flr|fl|room|rm|office|shop|pmb|box)\b[^0-9a-z]{0,3}(?:no[^0-9a-z]{0,2})?(?:apartment[^0-9a-z]{0,2}|apt[^0-9a-z]{0,2})?[a-z]?\d+"
FLOOR_PHRASE = r"\b\d+\s*(?:st|nd|rd|th)?\s*(?:floor|flr)\b"
PREMISE = r"[a-z0-9]+(?:[-/][a-z0-9]+)+|[a-z]+\d+[a-z0-9]*|\d+[a-z]+[a-z0-9]*"
ORDINAL = r"^\d+(?:st|nd|rd|th)$"

# Fixed values. Numbers of the method: folds, candidates a mode, weights, smoothing, stress on unmatched records, clipping.
FOLDS = 5
TOP_K = 10
NAME_WEIGHT = 0.5
PRIOR_SMOOTHING, PRIOR_MIN_COUNT = 50.0, 20
UNMATCHED_STRESS = 1.9
RESCORE_CUT, PAIR_TEXT_CHARS = 0.02, 300
CLIP, PRODUCT_SCALE = 1e-6, 10.0
NEGATIVE_RANK, EXTRA_NEGATIVES = 6, 100
RECALL_GATE = 0.97
