"""Word lists of the normalisers."""

# Results depend on these words, so they equal those that users of the lists expect.
LEGAL_SUFFIXES = """
inc incorporated corp corporation co company ltd limited llc llp pllc pc
pvt private enterprises enterprise industries industry associates consulting services solutions trust foundation
sarl sas sasu sa eurl sci snc gie sca association ets etablissements
gmbh ag kg ohg ug
bv nv
sl srl spa
""".split()

# Legal suffixes that are folded into another one.
SUFFIX_FOLDS = {"incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd", "private": "pvt"}

# Street words and their abbreviations.
STREET_FOLDS = {
    "street": "st", "road": "rd", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "court": "ct",
    "highway": "hwy", "parkway": "pkwy", "circle": "cir", "place": "pl", "square": "sq", "apartment": "apt", "floor": "fl",
    "building": "bldg", "opposite": "opp", "near": "nr", "sector": "sec", "block": "blk", "phase": "ph", "nagar": "ngr",
    "colony": "col", "rue": "r", "allee": "all", "chemin": "ch", "route": "rte", "impasse": "imp", "cite": "cit", "strasse": "str",
}

# Names of countries, and their code.
COUNTRY_FOLDS = {
    "usa": "us", "united states": "us", "united states of america": "us",
    "ind": "in", "india": "in", "bharat": "in",
    "fra": "fr", "france": "fr",
    "uk": "gb", "united kingdom": "gb", "great britain": "gb", "england": "gb",
    "deu": "de", "germany": "de", "deutschland": "de",
    "can": "ca", "canada": "ca",
    "aus": "au", "australia": "au",
    "chn": "cn", "china": "cn",
    "jpn": "jp", "japan": "jp",
}

# Endings that are cut off a domain, once.
DOMAIN_ENDINGS = ["com", "net", "org", "in", "fr", "co", "io", "biz", "info", "gouv.fr", "co.in", "co.uk", "edu", "gov", "mil", "int", "eu"]

# Latin letters that neither decomposition nor their name reduces to ASCII letters.
LETTERS = {"ß": "ss", "ẞ": "Ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ŋ": "ng", "Ŋ": "NG", "ı": "i"}
