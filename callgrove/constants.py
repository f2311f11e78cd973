"""Names, word lists, thresholds and patterns that results depend on."""

# --- fixed values: graph -------------------------------------------------------------
SINK_NAMES = [
    ("executeQuery", "SQLI"), ("exec", "RCE"), ("readObject", "DESER"), ("readValue", "DESER"),
    ("openConnection", "SSRF"), ("FileInputStream", "PATH_TRAV"), ("Paths.get", "PATH_TRAV"),
    ("ldapSearch", "LDAP"),
]
PATTERNS = {
    "sql_injection": ("method", ["executeQuery"]),
    "rce": ("method", ["exec", "Runtime"]),
    "deserialize": ("method", ["readObject", "readValue"]),
    "ssrf": ("method", ["openConnection"]),
    "path_traversal": ("method", ["FileInputStream", "Paths.get"]),
    "ldap": ("method", ["ldapSearch"]),
    "controller_method": ("class", ["Controller"]),
}
MAX_DEPTH, DEPTH_WARNING = 20, 15

# --- fixed values: endpoint extraction -----------------------------------------------
JAVA_TYPES = {
    "String": ("string", None), "int": ("integer", None), "Integer": ("integer", None),
    "long": ("integer", "int64"), "Long": ("integer", "int64"), "boolean": ("boolean", None),
    "Boolean": ("boolean", None), "double": ("number", None), "float": ("number", None),
    "byte[]": ("string", "binary"), "MultipartFile": ("string", "binary"),
}
HIGH_RISK_WORDS = [
    "sqlinjection", "sqli", "xxe", "ssrf", "pathtraversal", "deserializ", "rce", "exec", "command",
    "upload", "register", "login", "auth", "access-control", "missingac", "jwt", "crypto",
    "spoofcookie", "hijack",
]
FRAMEWORKS = {
    "org.springframework.boot": "spring-boot", "org.springframework": "spring",
    "org.apache.struts2": "struts2", "javax.ws.rs": "jax-rs", "org.apache.ibatis": "mybatis",
}

SKIP_PACKAGES = [
    "java.", "javax.", "jdk.", "org.springframework.", "org.apache.dubbo.", "org.apache.kafka.",
    "org.hibernate.", "com.fasterxml.jackson.",
]

# --- fixed values: findings -----------------------------------------------------------
MODES = ["A", "B", "C", "D", "INFO"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
SEVERITY_NAMES = {"致命": "CRITICAL", "严重": "HIGH", "中危": "MEDIUM", "低危": "LOW"}
POC_STATES = ["pending", "confirmed_vuln", "confirmed_safe", "inconclusive", "skipped_unreachable", "degraded"]
PROMOTION_THRESHOLD, PROMOTION_ROUNDS = 85, 3
FALSE_KILL_LIMIT, LOW_VALUE_SHARE, PRUNE_SAMPLE = 0.05, 0.70, 30
VERIFICATION_RATE, FAKE_SHARE = 0.75, 0.05
ROUND_DIMENSIONS = [
    ("execution", 30, 27), ("judgement", 30, 27), ("thinking", 30, 27), ("accuracy", 10, 9),
]
REPORT_STATES = ["是问题", "非问题", "暂时无法确认", "failed"]
TEMPLATE_SENTENCE = "缺乏充分的输入验证和输出编码"
STATE_MATRIX = [
    ("PENDING", "PAID", None), ("PAID", "SHIPPED", None), ("SHIPPED", "DELIVERED", None),
    ("DELIVERED", "CONFIRMED", None), ("PENDING", "CANCELED", None), ("PAID", "REFUNDED", 7),
]
SANITIZERS = {
    "SQL": [r"PreparedStatement", r"\.setString\(", r'\.matches\("\\d\+"\)', r"escapeSql"],
    "CMD": [r'\.matches\("\[a-zA-Z0-9\.\]\+"\)', r"Runtime\.exec\(new String\[\]"],
    "FILE": [r"\.getCanonicalPath\(\)", r'\.matches\("\[a-zA-Z0-9_\.-\]\+"\)'],
}
IMPACT_PATTERNS = {
    "confidentiality": [
        r"root:[x*]:0:0", r"admin@[a-z]+\.com", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"password\s*[:=]",
        r"api[_-]?key\s*[:=]", r"Bearer\s+[A-Za-z0-9]{20,}", r"flag\{[a-zA-Z0-9_-]+\}",
        r"\d+\s*rows?\s*in\s*set",
    ],
    "integrity": [
        r"(?:INSERT\s+INTO|UPDATE\s+\w+\s+SET|DELETE\s+FROM|DROP\s+TABLE)", r"successfully\s+(?:deleted|updated|inserted)",
        r'status":\s*"(?:ok|success|completed|true)', r"modified\s+\d+\s+rows?",
    ],
    "availability": [
        r"(?:500|503)\s+(?:Internal|Service)\s+Error", r"stack\s*trace", r"NullPointerException",
        r"OutOfMemoryError", r"timeout\s+after\s+\d+",
    ],
}
#: What makes a request an attack and not a test of reachability.
ATTACK_PAYLOADS = [
    r"(?i)(?:'|%27)\s*(?:or|and)\b", r"(?i)union\s+(?:all\s+)?select", r"(?i)<script|onerror\s*=|javascript:", r"\.\./\.\.|%2e%2e%2f",
    r"(?i)\$\{jndi:|%\{|\{\{", r"(?i)[;|&]\s*(?:cat|id|ls|whoami|ping|sleep)\b", r"(?i)<!ENTITY|<!DOCTYPE[^>]*SYSTEM", r"(?i)file:///|169\.254\.",
    r"(?i)--data\S*\s|\s-d\s|-X\s*(?:POST|PUT|PATCH|DELETE)", r"(?i)rO0AB|aced0005",
]
LEAK_PATTERNS = {
    "password": r"(?i)password\s*[:=]", "token": r"(?i)token",
    "id_card": r"\b\d{17}[\dXx]\b", "bank_card": r"\b\d{16,19}\b",
    "stack_output": r"printStackTrace\(|(?i:stack\s*trace)",
    "secret_log": r"(?i)log\w*\.(?:info|debug|warn|error)\([^)]*(?:password|token|secret)",
}
REDACTIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "bearer": r"Bearer\s+[A-Za-z0-9._-]+",
    "secret": r"(?i)(?:password|token|api[_-]?key)\s*[:=]\s*\S+",
}
ERROR_OUTPUTS = [
    "no class found", "no classloader found", r"class\s+\S+\s+not\s+found", "no method found", "error:",
    "exception", "not support", r"agent(?:\s+|-).*offline",
]
NEVER_RETRY = [
    "mc", "redefine", "retransform", "reset", "stop", "shutdown",
    "vmtool --action forcegc", "vmtool --action interruptthread",
]
EXIT_CODES = {
    "OK": 0, "ARGUMENT_ERROR": 1, "CONNECTION_ERROR": 10, "TIMEOUT": 11, "AUTH_FAILURE": 12,
    "AGENT_OFFLINE": 13, "ARTHAS_ERROR": 20, "CONFIG_ERROR": 30,
}

# --- fixed values: cache --------------------------------------------------------------
TTL_SECONDS = {
    "method": 86400, "astmatch": 86400, "chain": 3600, "prefetch": 3600, "judgment": 3600, "env": 3600,
    "draft": 2592000, "killed": 604800, "force-rescan": 604800, "final": None, "score": None,
}
