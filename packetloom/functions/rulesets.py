"""Rule tables: which patterns make which feature fire.

A rule is ``Rule(feature, kind, alternatives)``.  ``kind`` is ``flag`` (1 when
any alternative matches) or ``count`` (sum of literal occurrences).  An
alternative is a pattern over one *scope* of the payload:

==========  ================================================================
``n``       lower case, line breaks and tabs turned into blanks (default)
``lc``      lower case only
``raw``     the text as it came
``head``    ``n`` up to the first ``http/1.``
``tail``    ``n`` after the first ``http/1.``
==========  ================================================================

Patterns are ordinary regular expressions; see ``matching`` for how they are
turned into Column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Alt:
    pattern: str
    scope: str = "n"
    needs: str | None = None  # second pattern on scope ``n`` that must match too
    http_guard: bool = False  # only when the lower-cased payload has ``http/1.``
    literal: bool = False  # plain substring search, the pattern is no regex


@dataclass(frozen=True)
class Rule:
    feature: str
    alts: tuple[Alt, ...]
    kind: str = "flag"


def _n(*patterns: str) -> list[Alt]:
    return [Alt(p) for p in patterns]


def _lc(*patterns: str) -> list[Alt]:
    return [Alt(p, "lc") for p in patterns]


def _instr(*texts: str) -> list[Alt]:
    return [Alt(t, "lc", literal=True) for t in texts]


def _head(*patterns: str, guard: bool = False) -> list[Alt]:
    return [Alt(p, "head", http_guard=guard) for p in patterns]


def _tail(*patterns: str, guard: bool = False) -> list[Alt]:
    return [Alt(p, "tail", http_guard=guard) for p in patterns]


def _agents(*names: str, guard: bool = False) -> list[Alt]:
    return _tail(*(f"user(.*?)agent(.*?){name}" for name in names), guard=guard)


def _rule(feature: str, *groups: list[Alt]) -> Rule:
    return Rule(feature, tuple(a for g in groups for a in g))


def _count(feature: str, scope: str, *patterns: str) -> Rule:
    return Rule(feature, tuple(Alt(p, scope) for p in patterns), "count")


# --------------------------------------------------------------------------
# Fixed values.  The patterns below define the features; results depend on
# every character of them.
# --------------------------------------------------------------------------

NOT_WORD = "[^a-zA-Z0-9가-힣]"

# Alternatives that several families share.
DIR_PATHS = _n(
    r"current[\_]config(.*?)passwd",
    "well(.*?)known",
    "backup(.*?)sql",
    "robots(.*?)txt",
    "etc(.*?)passwd",
    "etc(.*?)shadow",
    "bash(.*?)history",
)
DIR_STEPS = (r"[\.][\.][\/]", r"[\.][\.][\%]2f", r"[\%]2e[\%]2e[\%]2f")
SHELL_COMMANDS = _n(
    f"wget{NOT_WORD}(.*?)ttp",
    r"rm(.*?)[\-]rf",
    f"cd{NOT_WORD}(.*?)tmp",
    f"chmod{NOT_WORD}(.*?)777",
)
SQL_READS = (
    "select(.*?)from",
    "select(.*?)count",
    "select(.*?)distinct",
    "union(.*?)select",
    "select(.*?)extractvalue(.*?)xmltype",
)
WORDPRESS = _n(r"wp[\-]login", r"wp[\-]content", r"wp[\-]include", r"wp[\-]config")
SCRIPT_CALLS = _n(
    "script(.*?)alert",
    "onerror(.*?)alert",
    "document(.*?)createelement",
    "document(.*?)forms",
    "document(.*?)location",
    "document(.*?)open",
)
LOOKUPS = _n("jndi(.*?)dap", "jndi(.*?)dns")
CRAWLERS = ("zgrab", "nmap", "dirbuster", "ahrefsbot", "baiduspider", "mj12bot", "petalbot")
TOOLS = ("semrushbot", "masscan", "sqlmap", "urlgrabber(.*?)yum")

# Features of the current IPS and WAF models; both use the same rules.
PAYLOAD_RULES = [
    _rule(
        "auth_comb",
        _n("currentsetting(.*?)htm"),
        _lc(r"get [\/]hnap1", "administrator"),
        _n("admin(.*?)serv(.*?)admpw"),
    ),
    _rule("auto_01_comb", _n("nikto", "arachni", "hydra", "scrapy")),
    _rule(
        "auto_02_comb",
        _n(
            "robots(.*?)txt",
            r"[\/]index[\.]jsp[\"][\-][\-][\>]",
            r"referer[\:](.*?)[\$](.*?)echo",
            "iisadmin",
            "iisadmpwd",
            "issamples",
            "htaccess",
            r"[\/]scripts[\/]",
            r"[\/][\_]vti[\_]",
            r"load_file[\(]",
            r"[\/]cgi[\-]",
            r"[\/]fcgi[\-]",
        ),
    ),
    _rule(
        "bof_comb",
        _lc("aaaaaaaaaa", "cacacacaca"),
        _instr(r"[\.]" * 10),
    ),
    _rule(
        "cgi_comb",
        _n("cgi(.*?)bin", "count(.*?)cgi(.*?)http"),
        _lc(r"[\.]cgi", "search(.*?)cgi", "bbs(.*?)forum(.*?)cgi", "web(.*?)store(.*?)cgi"),
        _n("count(.*?)cgi(.*?)http", "msadc(.*?)dll(.*?)http", "cgi(.*?)cgi(.*?)exe"),
    ),
    _rule("cookie_comb", _n(rf"designart[\_]site[\=]{NOT_WORD}")),
    _rule("cmd_01_comb", SHELL_COMMANDS),
    _rule(
        "cmd_02_comb",
        _n("cmd(.*?)open", "echo(.*?)shellshock"),
        _lc("powershell", r"[\/]tcsh"),
        _n(f"api(.*?){NOT_WORD}ping", f"get(.*?){NOT_WORD}ping"),
    ),
    _rule("code_comb", _n(f"eval{NOT_WORD}", r"php[\/]eval", "getruntime(.*?)exec")),
    _rule("dir_01_comb", DIR_PATHS),
    _rule("dir_02_comb", _lc("htaccess", "htpasswd", r"[\.]env", "access", r"[\/]bash")),
    _count("dir_count", "n", *DIR_STEPS),
    _rule("error_comb", _n("this(.*?)program(.*?)can"), _lc("80040e(.*?)font")),
    _rule(
        "file_comb",
        _n("filename(.*?)asp", "filename(.*?)jsp"),
        _lc(r"[\/]a[\.]jsp", r"[\.]asp[\;][\.]jpg"),
        _n("upload(.*?)asp", "fckeditor(.*?)filemanager", "manager(.*?)html"),
        _lc(r"[\.]mdb"),
    ),
    _rule("http_method_comb", _lc(r"delete [\/]", r"put [\/]", r"options [\/]")),
    _rule(
        "leakage_01_comb",
        _n(
            r"curl [\-]x",
            r"leak[\=]alalal",
            "postgresql",
            "oracle",
            "mssql",
            "mariadb",
            r"logon[\.]php(.*?)xmlhttprequest",
        ),
    ),
    _rule(
        "leakage_02_comb",
        _n(
            "mysqld",
            "mysqladmin",
            "phpmyadmin",
            r"fotter[\.]php",
            "su mysql",
            r"[\#]userid",
            r"[\#]password",
            r"[\#]btn",
        ),
    ),
    _rule("malware_comb", _lc(r"mozi[\.]")),
    _rule(
        "php_01_comb",
        _n("php(.*?)echo", "admin(.*?)php", "script(.*?)setup(.*?)php"),
        _lc("phpinfo", "phpmyadmin"),
        _n(
            "php(.*?)create(.*?)function",
            "php(.?)content(.*?)type",
            "upload(.*?)php",
            "sqlexec(.*?)php",
        ),
    ),
    _rule(
        "php_02_comb",
        _lc(f"md5{NOT_WORD}", f"{NOT_WORD}md5", r"[\$](.*?)md5(.*?)hash(.*?)password"),
    ),
    _rule("rce_comb", _n("apache(.*?)struts"), _lc("jdatabasedrivermysqli"), LOOKUPS),
    _rule(
        "sql_01_comb",
        _n(*SQL_READS, "and(.*?)select", "from(.*?)generate(.*?)series", "from(.*?)group(.*?)by"),
    ),
    _rule(
        "sql_02_comb",
        _n(
            "case(.*?)when",
            "then(.*?)else",
            f"like{NOT_WORD}",
            f"sleep{NOT_WORD}",
            "drop(.*?)table",
            "waitfor(.*?)delay",
            "db(.*?)sql(.*?)server",
            f"cast(.*?)chr{NOT_WORD}",
            f"cast(.*?)char{NOT_WORD}",
            "upper(.*?)xmltype",
        ),
    ),
    _rule(
        "sql_03_comb",
        _n(
            r"[\%]201[\=]1[\%]",
            r"1[\%]20[\=][\=][\%]201",
            rf"password[\=]1{NOT_WORD}",
            r"[\%]20or1[\=]1",
            r"or1[\=]1",
            " having ",
            r"having 1[\=]1",
            "sql(.*?)having",
            r"[\%]20having[\%]20",
        ),
    ),
    _rule(
        "sql_04_comb",
        _n(
            r"benchmark[\(]",
            r"alert[\(]",
            f"chr{NOT_WORD}",
            r"select[\%]20",
            r"exec[\+]cmd",
            r"1(.*?)[\+][\%]3d[\+](.*?)1",
            r"admin[\.]ht",
            r"submit[\=]submit",
            r"[\%]3a[\%]7bi",
            "pccsmysqladm",
            r"char[\(]",
            r"encrypt[\=]",
            r"login[\_]process",
        ),
    ),
    _rule(
        "sql_05_comb",
        _n(
            " group by ",
            r"[\%]20group[\%]20by",
            r"[\%]20where[\%]201[\=]1",
            r"shell[\_]exec[\(]",
            r"pg[\_]exec[\(]",
            r"[\$][\{]exec[\(]print",
            r"str[\=]exec[\(]",
            r"[\;]exec[\(][\"][\/]bin",
            f"exec{NOT_WORD}{NOT_WORD}",
        ),
    ),
    _rule(
        "sql_06_comb",
        _n(r"password[\%]3d1", r"admin[\&]password", r"password[\=]password"),
        [
            Alt(credential, needs=r"authorization[\:] basic ")
            for credential in (
                "ywrtaw46 ",
                "okfkbwluaxn0cmf0axzl ",
                "cm9vddp ",
                "ywrtaw5a ",
                "twfuywdlcjpmcmllza ",
                "omfkbwlu ",
                "ywrtaw46 ",
                "dxnlcl9hbmfsexn0omrlbw8 ",
                "dg9ty2f0og ",
                "bwfuywdlcjp",
            )
        ],
    ),
    _rule(
        "useragent_comb",
        _tail("bingbot", guard=True),
        _agents(*CRAWLERS, r"curl[\/]", *TOOLS, "zmeu", "gobuster", guard=True),
    ),
    _rule("wp_comb", WORDPRESS),
    _rule("xss_comb", SCRIPT_CALLS),
    _count("ampersand_count", "raw", r"[\&]"),
    _count("semicolon_count", "raw", r"[\;]"),
]

# Features of the web-server log model.
WEBLOG_RULES = [
    _rule(
        "sql_01_comb",
        _n(
            "select(.*?)from",
            "select(.*?)count",
            "select(.*?)concat",
            "select(.*?)distinct",
            "union(.*?)select",
            "select(.*?)extractvalue(.*?)xmltype",
            "from(.*?)generate(.*?)series",
            "from(.*?)group(.*?)by",
            "and(.*?)select",
        ),
    ),
    _rule(
        "sql_02_comb",
        _n(
            "case(.*?)when",
            "then(.*?)else",
            f"like{NOT_WORD}",
            f"sleep{NOT_WORD}",
            "delete(.*?)from",
            "drop(.*?)table",
        ),
    ),
    _rule("sql_03_comb", _n(r"where[\_]framework", r"sql[\_]server", r"order[\=]1", r"id[\=]0")),
    _rule(
        "sql_04_comb",
        _n(
            "waitfor(.*?)delay",
            "db(.*?)sql(.*?)server",
            f"cast(.*?)chr{NOT_WORD}",
            f"cast(.*?)char{NOT_WORD}",
            "upper(.*?)xmltype",
        ),
    ),
    _rule("sql_05_comb", _n("sql(.*?)select", "query(.*?)select", r"[\=]yes", r"[\=]true")),
    _rule(
        "xss_01_comb",
        _n("script(.*?)alert"),
        _lc("onmouseover"),
        _n(f"eval{NOT_WORD}", "onerror(.*?)alert", "document(.*?)open"),
    ),
    _rule("cmd_01_comb", SHELL_COMMANDS),
    _rule(
        "cmd_02_comb",
        _n(
            "syscmd(.*?)cmd",
            "exec(.*?)cmd(.*?)dir",
            "exec(.*?)cmd(.*?)ls",
            "cmd(.*?)open",
            f"get(.*?){NOT_WORD}ping",
        ),
    ),
    _rule(
        "cmd_03_comb",
        _n(
            "command",
            f"ping{NOT_WORD}",
            f"echo{NOT_WORD}",
            f"cat{NOT_WORD}",
            r"shell[\_]exe",
        ),
    ),
    _rule("dir_01_comb", DIR_PATHS),
    _count("dir_count", "n", *DIR_STEPS),
    _count("ampersand_count", "raw", r"[\&]"),
    _count("semicolon_count", "raw", r"[\;]"),
]

# Flags of the labelled IPS training table.
TRAINING_RULES = [
    Rule(
        "base64",
        tuple(
            Alt(p, "raw")
            for p in (
                "VCAvY2dpLWJpbi9waHA0",
                "L2NnaS1iaW4v",
                "IC9jZ2ktYmlu",
                "UE9TVCAvY2dpLWJpbi9waHA/",
                "VCAvY2dpLWJpbi9w",
                "ZGllKEBtZDU=",
                "L2FueWZvcm0yL3VwZGF0ZS9hbnlmb3JtMi5pbmk=",
                "Ly5iYXNoX2hpc3Rvcnk=",
                "L2V0Yy9wYXNzd2Q=",
                "QUFBQUFBQUFBQQ==",
                "IG1hc3NjYW4vMS4w",
                "d2dldA==",
                "MjB3YWl0Zm9yJTIwZGVsYXklMjAn",
                "V0FJVEZPUiBERUxBWQ==",
                "ZXhlYw==",
                "Tm9uZQ==",
                "OyB3Z2V0",
                "VXNlci1BZ2VudDogRGlyQnVzdGVy",
                "cGhwIGRpZShAbWQ1",
                "JTI4U0VMRUNUJTIw",
            )
        ),
    ),
    _rule(
        "sql_comb_01",
        _head(*SQL_READS, "from(.*?)generate(.*?)series", "from(.*?)group(.*?)by"),
    ),
    _rule("sql_comb_02", _head("case(.*?)when", "then(.*?)else", "like", "sleep", "delete")),
    _rule(
        "sql_comb_03",
        _head("waitfor(.*?)delay", "db(.*?)sql(.*?)server", "cast(.*?)chr", "upper(.*?)xmltype"),
    ),
    _rule("xss_comb_01", _n("script(.*?)alert"), _lc("eval")),
    _rule("cmd_comb_01", _head("wget(.*?)ttp", "chmod(.*?)777", "rm(.*?)rf", "cd(.*?)tmp")),
    _rule("log4j_comb_01", LOOKUPS),
    _rule(
        "word_comb_01",
        _n(
            "etc(.*?)passwd",
            "document(.*?)createelement",
            "cgi(.*?)bin",
            "document(.*?)forms",
            "document(.*?)location",
            "fckeditor(.*?)filemanager",
            "manager(.*?)html",
            "current_config(.*?)passwd",
            "currentsetting(.*?)htm",
            "well(.*?)known",
        ),
    ),
    _rule(
        "word_comb_02",
        _n(
            "bash(.*?)history",
            "apache(.*?)struts",
            "document(.*?)open",
            "backup(.*?)sql",
            "robots(.*?)txt",
            "sqlexec(.*?)php",
        ),
        _lc("htaccess", "htpasswd"),
        _n("cgi(.*?)cgi", "api(.*?)ping"),
    ),
    _rule(
        "word_comb_03",
        _lc("aaaaaaaaaa", "cacacacaca", r"mozi[\.]", "bingbot", "md5"),
        _n(
            "jpg(.*?)http/1.",
            "count(.*?)cgi(.*?)http",
            "this(.*?)program(.*?)can",
            "get(.*?)ping",
            "msadc(.*?)dll(.*?)http",
            "filename(.*?)asp",
            "filename(.*?)jsp",
        ),
        _lc("powershell", r"[\.]env"),
    ),
    _rule("wp_comb_01", _n("wp-login", "wp-content", "wp-include", "wp-config")),
    _rule(
        "word_comb_04",
        _n(
            "cmd(.*?)open",
            "echo(.*?)shellshock",
            "php(.*?)echo",
            "admin(.*?)php",
            "script(.*?)setup(.*?)php",
        ),
        _lc("phpinfo", "administrator", "phpmyadmin", "access", "mdb"),
        _n(
            "wise(.*?)survey(.*?)admin",
            "admin(.*?)serv(.*?)admpw",
            "php(.*?)create(.*?)function",
        ),
    ),
    _rule("useragent_comb", _agents(*CRAWLERS, "curl/", *TOOLS)),
    _count(
        "whitelist",
        "n",
        "get(.*?)http/1.",
        "post(.*?)http/1.",
        "head(.*?)http/1.",
        "option(.*?)http/1.",
    ),
]


def _earlier_waf_rules() -> list[Rule]:
    now = {r.feature: r for r in PAYLOAD_RULES}

    def same(feature: str) -> Rule:
        return now[feature]

    def without(feature: str, *patterns: str, name: str | None = None) -> Rule:
        kept = tuple(a for a in now[feature].alts if a.pattern not in patterns)
        return replace(now[feature], feature=name or feature, alts=kept)

    return [
        _rule(
            "auth_comb",
            _n("currentsetting(.*?)htm"),
            _instr("get /hnap1"),
            _lc("administrator"),
            _n("admin(.*?)serv(.*?)admpw"),
        ),
        without("bof_comb", r"[\.]" * 10),
        _rule(
            "cmd_01_comb",
            _head("wget(.*?)ttp", "chmod(.*?)777", r"rm(.*?)[\-]rf", "cd(.*?)tmp", guard=True),
        ),
        _rule(
            "cmd_02_comb",
            _n("cmd(.*?)open", "echo(.*?)shellshock"),
            _lc("powershell"),
            _instr("/tcsh"),
            _n("api(.*?)ping", "get(.*?)ping"),
        ),
        _rule("code_comb", _lc("eval"), _n("getruntime(.*?)exec")),
        _rule("dir_01_comb", _n("current_config(.*?)passwd"), DIR_PATHS[1:]),
        _rule("dir_02_comb", _lc("htaccess", "htpasswd", r"[\.]env", "access"), _instr("/bash")),
        _count("dir_count", "n", r"[\.][\.]/", r"[\.][\.][%%]2f", "[%%]2e[%%]2e[%%]2f"),
        _rule(
            "cgi_comb",
            _n("cgi(.*?)bin", "cgi(.*?)cgi", "count(.*?)cgi(.*?)http"),
            _instr(".cgi"),
            _lc("search(.*?)cgi", "bbs(.*?)forum(.*?)cgi", "web(.*?)store(.*?)cgi"),
            _n(
                "count(.*?)cgi(.*?)http",
                "msadc(.*?)dll(.*?)http",
                "cgi(.*?)cgi(.*?)cgimail(.*?)exe",
                "cgi(.*?)cgi(.*?)fpcount(.*?)exe",
                "cgi(.*?)cgi(.*?)rguest(.*?)exe",
            ),
        ),
        same("wp_comb"),
        _rule(
            "error_comb",
            _n("this(.*?)program(.*?)can"),
            _lc("80040e07(.*?)font", "80040e14(.*?)font"),
        ),
        _rule(
            "file_comb",
            _n("filename(.*?)asp", "filename(.*?)jsp"),
            _instr("/a.jsp", ".asp;.jpg"),
            _n("upload(.*?)asp", "fckeditor(.*?)filemanager", "manager(.*?)html"),
            _lc("mdb"),
        ),
        _rule("http_method_comb", _instr("delete /", "put /")),
        same("malware_comb"),
        same("rce_comb"),
        _rule(
            "sql_01_comb",
            _head(
                *SQL_READS,
                "and(.*?)select",
                "from(.*?)generate(.*?)series",
                "from(.*?)group(.*?)by",
                guard=True,
            ),
        ),
        _rule(
            "sql_02_comb",
            _head(
                "case(.*?)when",
                "then(.*?)else",
                "like",
                "sleep",
                "delete",
                "drop",
                "waitfor(.*?)delay",
                "db(.*?)sql(.*?)server",
                "cast(.*?)chr",
                "upper(.*?)xmltype",
                guard=True,
            ),
        ),
        without("useragent_comb", "user(.*?)agent(.*?)gobuster"),
        _rule(
            "php_comb",
            _n("php(.*?)echo", "admin(.*?)php", "script(.*?)setup(.*?)php"),
            _lc("phpinfo", "phpmyadmin"),
            _n("php(.*?)create(.*?)function", "php(.?)content(.*?)type"),
            _lc("md5"),
            _n("upload(.*?)php", "sqlexec(.*?)php"),
        ),
        same("xss_comb"),
    ]


EARLIER_WAF_RULES = _earlier_waf_rules()

# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Family:
    """A rule table with the column prefix of one device model."""

    name: str
    prefix: str
    rules: tuple[Rule, ...]

    @property
    def features(self) -> list[str]:
        return [self.prefix + r.feature for r in self.rules]

    @property
    def counts(self) -> list[str]:
        return [self.prefix + r.feature for r in self.rules if r.kind == "count"]


FAMILIES = {
    f.name: f
    for f in (
        Family("ips", "ips_payload_", tuple(PAYLOAD_RULES)),
        Family("waf", "waf_payload_", tuple(PAYLOAD_RULES)),
        Family("web", "weblog_", tuple(WEBLOG_RULES)),
        Family("ips_training", "ips_00001_payload_", tuple(TRAINING_RULES)),
        Family("waf_v1", "waf_payload_", tuple(EARLIER_WAF_RULES)),
    )
}


def family(name: str, *, fixed_dots: bool = False) -> Family:
    """Look up a family.

    ``fixed_dots`` repairs the overflow rule that searches for the ten dots
    as bracketed text; by default the rule stays as the models were trained.
    """
    found = FAMILIES[name]
    if not fixed_dots:
        return found
    rules = tuple(
        replace(r, alts=tuple(replace(a, literal=False) for a in r.alts))
        if r.feature == "bof_comb"
        else r
        for r in found.rules
    )
    return replace(found, rules=rules)


def keyword_patterns(rule: Rule) -> list[str]:
    """The patterns of a rule as keywords; a second condition comes first."""
    out: list[str] = []
    for a in rule.alts:
        if a.needs and a.needs not in out:
            out.append(a.needs)
        out.append(a.pattern)
    return out
