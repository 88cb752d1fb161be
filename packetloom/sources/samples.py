"""Small example dimensions: geography, signatures, descriptions, coefficients.

They stand in for the tables a deployment brings along; every operator takes
the table as an argument.
"""

from __future__ import annotations

from packetloom.functions.rulesets import FAMILIES
from packetloom.sources.dims import Dim


def _ip(a: int, b: int = 0, c: int = 0, d: int = 0) -> int:
    return ((a * 256 + b) * 256 + c) * 256 + d


GEO_RANGES = Dim(
    "start_ip BIGINT, end_ip BIGINT, country STRING",
    [
        (_ip(1), _ip(9, 255, 255, 255), "Australia"),
        (_ip(11), _ip(40, 99, 255, 255), "United States"),
        (_ip(40, 100), _ip(40, 100, 127, 255), "Canada"),
        (_ip(41), _ip(61, 255, 255, 255), "South Africa"),
        (_ip(77), _ip(95, 255, 255, 255), "Germany"),
        (_ip(101), _ip(126, 255, 255, 255), "South Korea"),
        (_ip(133), _ip(133, 255, 255, 255), "Japan"),
        (_ip(150, 20), _ip(176, 200, 9, 77), "France"),
        (_ip(189), _ip(201, 255, 255, 255), "Brazil"),
        (_ip(210), _ip(223, 255, 255, 255), "China"),
    ],
)

SIGNATURES = Dim(
    "pattern_no INT, pattern STRING, vendor STRING, device STRING, detection_name STRING, "
    "description STRING, response STRING",
    [
        (1, "union select", "W", "S", "SQL union", "reads other tables", "bind parameters"),
        (2, "/etc/passwd", "S", "M", "account file", "reads local accounts", "restrict paths"),
        (3, "<script", "W", "S", "script tag", "runs script in the page", "escape output"),
        (4, "xp_cmdshell", "I", "N", "shell procedure", "runs commands", "disable procedure"),
        (5, "../", "S", "M", "parent path", "leaves the web root", "normalise paths"),
        (6, "sqlmap", "", "N", "SQL tool", "automatic injection", "block the agent"),
        (7, "SQLMAP", "W", "N", "SQL tool again", "same text, later entry", "none"),
        (8, "zgrab", "I", "", "port scanner", "scans the network", "block the source"),
        (9, "wp-login", "W", "S", "blog login", "guesses passwords", "limit logins"),
        (10, "select", "W", "S", "SQL word", "may read tables", "review"),
        (11, "jndi:", "S", "M", "lookup", "loads remote code", "update library"),
    ],
)

# Descriptions exist for most features only, so that the left join has misses.
FEATURE_DEFS = Dim(
    "feature STRING, description STRING",
    [
        (f, "counts " + f[12:] if f.endswith("count") else "detects " + f[12:].replace("_comb", ""))
        for i, f in enumerate(FAMILIES["ips"].features)
        if i % 9 != 4
    ],
)


def coefficients(fam: str) -> Dim:
    """Example linear model; the values follow a rule, not a training."""
    rows = []
    for i, f in enumerate(FAMILIES[fam].features):
        weight = 0.05 if f.endswith("count") else 0.4 + 0.07 * (i * 5 % 13)
        sign = -1.0 if i % 7 == 3 else 1.0
        rows.append((i, f, round(sign * weight, 4)))
    return Dim("feature_no INT, feature STRING, coef DOUBLE", rows)


INTERCEPT = -1.1

#: What the four log classes respond to: shell, nothing, database, page scripts.
LOG_CLASS_WORDS = (("cmd", "dir"), (), ("sql",), ("xss", "semicolon"))
LOG_INTERCEPTS = {0: -1.2, 1: 0.9, 2: -1.0, 3: -1.4}


def log_class_coefficients() -> Dim:
    """Example linear model of the log classes, with the feature means it was made for."""
    rows = []
    for c, words in enumerate(LOG_CLASS_WORDS):
        for i, f in enumerate(FAMILIES["web"].features):
            count = f.endswith("count")
            if any(w in f for w in words):
                weight = 0.15 if count else 1.1 + 0.09 * (i * 5 % 7)
            else:
                weight = -0.02 * (c + 1) if count else -0.35 - 0.03 * (i * 3 % 5) - 0.2 * (c == 1)
            rows.append((c, i, f, round(weight, 4), 0.6 if count else round(0.02 + 0.015 * i, 4)))
    return Dim("class_no INT, feature_no INT, feature STRING, coef DOUBLE, mean DOUBLE", rows)


LOG_FEATURE_DEFS = Dim(
    "feature STRING, description STRING",
    [(f, f"log rule {i + 1}") for i, f in enumerate(FAMILIES["web"].features) if i % 5 != 3],
)

AGENT_VOCABULARY = Dim(
    "feature STRING, word STRING, idf DOUBLE",
    [
        (f"token_{i:03d}", w, idf)
        for i, (w, idf) in enumerate(
            [
                ("bingbot", 3.5),
                ("bot", 1.75),
                ("chrome", 1.25),
                ("compatible", 1.5),
                ("curl", 3.25),
                ("firefox", 2.25),
                ("github", 3.0),
                ("gobuster", 4.0),
                ("googlebot", 2.75),
                ("http", 1.125),
                ("masscan", 4.25),
                ("mozilla", 0.5),
                ("nikto", 4.5),
                ("org", 2.5),
                ("safari", 1.375),
                ("sqlmap", 4.125),
                ("windows", 1.0),
                ("yeti", 3.75),
                ("zgrab", 4.375),
            ]
        )
    ],
)

PAYLOAD_VOCABULARY = Dim(
    "feature STRING, word STRING, idf DOUBLE",
    [
        (f"token_{i:03d}", w, idf)
        for i, (w, idf) in enumerate(
            [
                ("get", 0.5),
                ("item", 0.25),
                ("host:", 0.375),
                ("agent:", 0.125),
                ("select", 3.5),
                ("from", 2.5),
                ("union", 3.25),
                ("passwd", 4.0),
                ("admin", 3.0),
                ("cmd", 2.75),
                ("mozilla", 1.0),
                ("1.1", 0.75),
                ("", 0.0625),
                ("http", 0.625),
            ]
        )
    ],
)

# class, word, weight of a linear agent classifier
AGENT_WEIGHTS = Dim(
    "agent_class STRING, word STRING, weight DOUBLE",
    [
        ("application", "chrome", 1.0),
        ("application", "safari", 0.75),
        ("application", "firefox", 1.25),
        ("application", "mozilla", 0.5),
        ("application", "windows", 0.5),
        ("normal_bot_crawler", "googlebot", 2.0),
        ("normal_bot_crawler", "bingbot", 2.0),
        ("normal_bot_crawler", "compatible", 1.5),
        ("normal_bot_crawler", "yeti", 2.0),
        ("bad_bot_crawler", "zgrab", 2.5),
        ("bad_bot_crawler", "sqlmap", 2.5),
        ("bad_bot_crawler", "masscan", 2.5),
        ("bad_bot_crawler", "nikto", 2.5),
        ("bad_bot_crawler", "curl", 1.5),
        ("bad_bot_crawler", "gobuster", 2.5),
    ],
)

AGENT_INTERCEPTS = Dim(
    "agent_class STRING, intercept DOUBLE",
    [("application", 0.25), ("normal_bot_crawler", 0.0), ("bad_bot_crawler", 0.0)],
)

# token, weight of a linear text model
TOKEN_WEIGHTS = Dim(
    "token STRING, weight DOUBLE",
    [
        ("select", 1.3),
        ("union", 1.1),
        ("passwd", 1.7),
        ("script", 0.9),
        ("cmd", 0.8),
        ("get", -0.2),
        ("post", 0.15),
        ("item", -0.4),
        ("host:", -0.3),
        ("agent:", -0.1),
        ("admin", 0.7),
        ("/", 0.05),
        ("+", 0.1),
        ("?", -0.05),
        (" ", 0.0),
        ("mozilla", -0.25),
        ("1.1", -0.15),
    ],
)

# family, techniques
TECHNIQUES = Dim(
    "family STRING, technique_ids STRING",
    [
        ("Clop", "T1059.003, T1486, T1140, T1083"),
        ("Maze", "T1071.001, T1547.001, T1486"),
        ("Conti", "T1059.003, T1486, T1490, T1135, T1018"),
        ("Bad Rabbit", "T1110.003, T1486, T1189"),
        ("Cuba", "T1134, T1059.001, T1486"),
        ("Pysa", "T1110, T1059.001, T1003.001"),
        ("JCry", "T1547.001, T1204.002"),
        ("Diavol", "T1485, T1491.001"),
    ],
)
