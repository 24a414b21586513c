"""The few regular expressions of the normalisers and tokens."""

SPACE = r"[\s\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}\p{M}_\s\p{Z}]"
#: What stands between runs of letters, digits and underscores.
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
SCHEME = r"(?i)^https?://"
PORT = ":[0-9]+$"
WWW = r"(?i)^www[0-9]?\."
HOST_LETTERS = "^[A-Za-z0-9.-]+$"
DIGITS = "^[0-9]+$"
POSTAL_DIGITS = "^[0-9]{5,6}$"
#: A French delivery word as a word of its own, with the number behind it if there is one.
DELIVERY = r"\b(?:cedex|bp)\b(?:\s+[0-9]+\b)?"
PHONE_SIGNS = " \t\n\x0b\x0c\r-.()+"
PHONE_DIGITS = "[0-9]{7,15}"
