"""The patterns, word lists, weights and limits of the rule operators."""

FORCE_SEARCH = (
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"/root/[a-zA-Z]", r"/etc/(nginx|hosts|cron|network)",
    r"\b(remember this|store this|save (this|that|it)|add (this|that) to (memory|your memory))\b", r"\bwhat do you know about\b",
    r"\b([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b",
)
CONTEXT_SIGNALS = (
    (r"\b(that|the|this|those)\s+(project|client|config|setup|thing|issue|bug|error|server|script|file|setting|deployment|container|service)\b", 0.30),
    (r"\bhis\s+(config|setup|environment|server|tenant)\b", 0.25),
    (r"\b(its|their)\s+(config|setup|status|state)\b", 0.20),
    (r"\b(we discussed|we talked about|last time|previously|earlier|remember when|you said|you mentioned)\b", 0.40),
    (r"\b(what was|where was|when did|how did we|what did we|did we decide|did we set)\b", 0.30),
    (r"\b(the same|like before|as before|again)\b", 0.20),
    (r"^(yes|yeah|yep|do it|go ahead|proceed|ok|okay|sure|right)\s*[.!?]?\s*$", 0.35),
    (r"^(where|what|how|why|when)\s*[?]?\s*$", 0.30),
    (r"^(and|also|plus|but)\s", 0.20),
    (r"\b(qdrant|mem0|custodian|autotuner|entity.?boost)\b", 0.20),
    (r"\b(my (server|vps|docker|container|setup|config|cron|daemon|network))\b", 0.15),
    (r"\b(the (daemon|custodian|ingest|digest|backup|memory))\b", 0.15),
    (r"\b(how (do|can|to|would) (i|you|we|one))\b", -0.25),
    (r"\b(what is|what are|what does|explain|define|describe)\b", -0.20),
    (r"\b(tutorial|example|syntax|documentation)\b", -0.15),
    (r"\b(in (python|bash|powershell|javascript|go|rust|java|c\+\+))\b", -0.15),
    (r"\b(what is a|what are the|difference between)\b", -0.20),
    (r"\b(best practice|convention|standard|pattern)\b", -0.10),
    (r"(here'?s (my|the|a) (code|config|error|log|output|file))", -0.30),
    (r"```", -0.25),
    (r"(i have|i got|i see|i'm getting|i'm seeing)\s+(this|an?|the)\s+(error|issue|problem|warning)", -0.15),
    (r"\b(restart|stop|start|reload|check|run|execute|install|update|upgrade|deploy)\s+(the\s+)?(nginx|docker|service|daemon|container|server|cron|script)\b", -0.20),
    (r"\b(install|pip install|npm install|apt install|brew install)\s+\S+", -0.20),
    (r"\b(ls|cd|cat|grep|find|ps|top|df|du|free|uname)\b", -0.15),
)
STORE_TRIGGERS = (
    (r"\b(fixed|resolved|working now|that.?s (it|the fix)|no longer)\b", "fix"),
    (r"\b(root cause|the issue was|the problem was|turned out (to be|it was))\b", "fix"),
    (r"\b(updated|changed|modified|set|configured|tuned)\s+(the\s+)?(config|setting|value|parameter|cron|rule|policy)\b", "config"),
    (r"\b(docker compose (up|build|restart|down))\b", "deployment"),
    (r"\b(deployed|redeployed|rebuilt|container (is|now) running)\b", "deployment"),
    (r"\b(added|created|registered|integrated|wired\s+up|now in HA|now in home assistant)\b", "addition"),
    (r"\b(entity|device|integration|config entry|config flow)\b.*\b(added|created|loaded)\b", "addition"),
    (r"\b(decided|going with|chose|chose to|will use|best approach|recommended)\b", "decision"),
    (r"\b(instead of|rather than|over|vs\.?)\b.*\b(because|since|as it)\b", "decision"),
    (r"\b(token|api.?key|password|credential)\b.*\b(at|in|stored|located)\b", "credential"),
    (r"\b(found (at|in|under)|lives at|stored at|located at)\b.*(/[a-z]|\d{1,3}\.\d)", "location"),
)
TOPICS = (
    ("home_automation", r"\b(home.?assistant|HA\b|entity|automation|switch\.|sensor\.|binary_sensor|mqtt|zigbee|zwave|homebridge)\b"),
    ("networking", r"\b(vlan|subnet|tailscale|nginx|dns|cloudflare|dnat|route|gateway|firewall)\b"),
    ("memory_system", r"\b(mem0|qdrant|custodian|session.?ingest|conversation.?digest|compaction|context.?gate|memory.?system)\b"),
    ("iot_devices", r"\b(iot|mqtt|sensor|actuator|firmware|esp32|raspberry.?pi|arduino|zigbee|zwave)\b"),
    ("transport", r"\b(ev.?charger|evse|charging|vehicle|car|truck|fleet)\b"),
    ("vps_infra", r"\b(vps|docker|container|compose|systemd|cron|nginx|certbot|letsencrypt)\b"),
    ("clients", r"\b(client|tenant|operator.?connect|direct.?routing|teams)\b"),
    ("api_keys", r"\b(token|api.?key|credential|secret|password|auth|bearer|openrouter|anthropic|moonshot)\b.*\b(at|in|path|stored|located|root)\b"),
)
COMPARISON_WORDS = ("compare", "vs", "versus", "difference", "between", "should i", "which", "pros and cons", "trade-off", "tradeoff")
PLANNING_WORDS = ("plan", "design", "architect", "strategy", "how should", "what if", "approach", "roadmap", "migrate", "refactor")
TECHNICAL = r"\b(docker|nginx|mqtt|vps|server|deploy|api|config|cron|daemon|postgres|redis|qdrant|inverter|modbus|esphome|mqtt|graph|memory)\b"
CAPITALISED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
IMPACT = (
    ("critical", r"\b(credential|secret|api.?key|password)\b.*\b(changed|rotated|compromised|leaked)\b"),
    ("critical", r"\b(data.?loss|outage|security.?breach|incident)\b"),
    ("high", r"\b(deployed|shipped|released|launched)\b"),
    ("high", r"\b(fixed|resolved|debugged|root.?cause)\b.*\b(bug|issue|error|crash|failure)\b"),
    ("high", r"\b(bug|issue|error|crash|failure)\b.*\b(fixed|resolved|debugged|root.?cause)\b"),
    ("high", r"\b(architecture|design.?decision|chose|decided|switched.?to)\b"),
    ("high", r"\b(wrong|incorrect|stale|outdated)\b.*\b(path|config|file|setting)\b"),
    ("high", r"\b(path|config|file|setting)\b.*\b(wrong|incorrect|stale|outdated|should.?be)\b"),
    ("high", r"\b(migration|schema.?change|breaking.?change)\b"),
    ("high", r"\b(container|docker)\b.*\b(build|rebuild|image)\b.*\b(from|source|path)\b"),
    ("high", r"\b(mount|volume|bind)\b.*\b(correct|actual|real)\b"),
)
BUCKETS = (
    ("CONSTRAINTS", (
        (r"\b(must|required|requires?|mandatory|critical|necessary)\b", 0.90), (r"\b(always|never|do not|don't|cannot|must not)\b", 0.85),
        (r"\b(chose|chosen|decided|selected|switched to|migrated to)\b", 0.88), (r"\b(constraint|restriction|limitation|requirement)\b", 0.92),
        (r"\b(set to|configured? (?:to|as|for)|bound to|pinned to)\b", 0.80), (r"\b(IP (?:is|address)|port \d+|uses? port)\b", 0.82),
        (r"\b(depends? on|dependency|prerequisite)\b", 0.78),
    )),
    ("PROCEDURES", (
        (r"\b(run|execute|restart|deploy|install|start|stop|kill)\b", 0.80), (r"`[^`]+`", 0.75), (r"\b(step \d|first|then|next|finally|after that)\b", 0.82),
        (r"\b(docker[- ]compose|systemctl|pip install|npm|curl|scp|ssh)\b", 0.85), (r"\b(to fix|to resolve|to clear|to update|to build|to push)\b", 0.78),
        (r"\b(OTA|firmware|update|upgrade|rebuild)\b", 0.72),
    )),
    ("HISTORICAL", (
        (r"\b(originally|previously|used to|was formerly|legacy|deprecated)\b", 0.80), (r"\b(old|former|prior|replaced by|superseded|obsolete)\b", 0.75),
        (r"\b(v1|version 1|initial|first version|prototype)\b", 0.72), (r"\b(removed|dropped|no longer|discontinued)\b", 0.78), (r"\b(migrated from|moved from|switched from)\b", 0.76),
    )),
    ("UNCERTAINTIES", (
        (r"\b(unclear|unknown|unconfirmed|not confirmed|uncertain)\b", 0.90), (r"\b(may|might|possibly|perhaps|could be|not sure)\b", 0.75),
        (r"\b(TODO|TBD|pending|needs? investigation|needs? verification)\b", 0.85), (r"\b(not accessible|exception|error|failed|broken)\b", 0.70), (r"\b(no .* found|not found|missing|absent)\b", 0.78),
    )),
)
NAME_SKIP = (r"^.{0,2}$", r"^\d+$", r"^[A-Z]{1,3}$", r"(?i)^(true|false|none|null)$", r"(?i)^(yes|no|on|off)$", r"(?i)^(Project|project)$", r"(?i)^(traffic|core tools|data|info|status|error|output|input|result)$", r"(?i)^(Phase \d|Step \d)")
#: Pattern, type, and a pattern that must not match.
NAME_TYPES = (
    (r"(?i)\b(api.?key|token|credentials?|password|secret|auth.?token)\b", "credential", None),
    (r"(?i)\b(register\s+0x|reg\s+0x|0x[0-9a-fA-F]{3,})\b", "register", None), (r"(?i)^Register\s+", "register", None),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(/\d{1,2})?\b", "infrastructure", None),
    (r"(?i)\b(subnet|CIDR|VLAN|gateway|firewall|DNS|DHCP|NAT|DNAT|VPN|WireGuard)\b", "infrastructure", None), (r"(?i)\b(iptables|ip rule|network)\b", "infrastructure", None),
    (r"(?i)\b(routing)\b", "infrastructure", r"(?i)\b(routing)\b.*\b(model|config|task|template)"),
    (r"(?i)\b(container|docker)\b", "container", None), (r"(?i)\b(sensor|temperature|humidity|power meter|energy meter|Shelly)\b", "sensor", None),
    (r"(?i)^(MQTT|Modbus|SIP|HTTP|REST|gRPC|RS485|RS232|TCP|UDP|WebSocket)$", "protocol", None), (r"(?i)\b(automation|schedule|cron|timer|trigger)\b", "automation", None),
    (r"(?i)\.(py|sh|yaml|yml|json|conf|toml|ini)$", "script", None), (r"(?i)^(script|config|Dockerfile)", "script", None), (r"@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "person", None),
    (r"(?i)\b(bot|agent|daemon|worker)\b", "agent", None), (r"(?i)\bbridge\b", "agent", r"(?i)\bbridge\b.*\bconfig"),
    (r"(?i)\b(ESP32|inverter|dongle|relay|board|hardware|firmware)\b", "device", None), (r"(?i)\b(API|endpoint|server|service|gateway|webhook|dashboard)\b", "service", None),
    (r"(?i)^(Home Assistant|HAOS|Node-RED|Mosquitto|Grafana|PostgreSQL|Redis|Qdrant|Mem0)$", "system", None),
)
CORRECTIONS = (r"\b(no,?\s+(?:it|that|this|actually))", r"\b(that'?s (?:wrong|incorrect|not right|not what))", r"\b(actually,?\s+(?:it|the|that))", r"\bwrong\b", r"\b(i meant|i said|i asked for)", r"\b(not what i (?:meant|wanted|asked))", r"\b(correction|correcting)")
FACT_SIGNALS = ((r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", 3), (r"/[a-z][\w/.-]{3,}", 2), (r"(?i)\b(fixed|deployed|configured|created|added|resolved)\b", 2), (r"(?i)\b(error|issue|bug|problem)\b", 1))
FILE_MARKERS = ("{", "[", "#!", "---", "<?xml", "<!DOCTYPE", "<!doctype", "CREATE ", "ALTER ", "SELECT ", "INSERT ", "DROP ", "package ", "import ", "from ", "def ", "class ", "func ", "module ", "namespace ", "using ", "#include")
DIALOGUE = ("User:", "Assistant:", "Human:")
FAILURE_WORDS = ("fix", "error", "bug", "broke", "fail", "issue", "crash", "troubleshoot")
PREFERENCE_WORDS = ("prefer", "chose", "decided", "uses ", "switched", "instead of", "rather than", "always", "configured", "setup", "approach")
INJECTIONS = ((r"(?i)respond\s+with\s+\{", "[FILTERED] {"), (r"(?i)ignore\s+(previous|above|all)\s+instructions?", "[FILTERED]"), (r"(?i)</?system>", "[FILTERED]"))
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "his", "how", "its", "may", "new", "now", "old", "see",
    "way", "who", "did", "get", "let", "say", "she", "too", "use", "this", "that", "with", "have", "from", "they", "been", "some", "what", "when", "will", "more", "into",
    "also", "than", "them", "very", "just", "about", "which", "their", "there", "would", "could", "should", "where", "like", "only", "then", "each", "make", "made",
    "does", "done", "most", "such", "here", "much", "many",
)
TAG_STOP_WORDS = (
    "the", "are", "was", "were", "been", "being", "have", "has", "had", "does", "did", "will", "would", "could", "should", "may", "might", "can", "shall", "for", "with",
    "from", "into", "through", "during", "before", "after", "above", "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "both", "each", "few", "more", "most", "other", "some", "such", "nor", "not", "only", "own", "same", "than", "too", "very", "just",
    "about", "its", "what", "which", "who", "whom", "this", "that", "these", "those", "our", "you", "your", "him", "his", "she", "her", "they", "them", "their", "and", "but",
)
WEIGHTS = {
    "default": {"semantic": 0.30, "graph_walk": 0.10, "recency": 0.15, "goal_prox": 0.15, "oq_boost": 0.10, "narrative": 0.05, "working_mode": 0.10, "frequency": 0.05},
    "semantic-heavy": {"semantic": 0.45, "graph_walk": 0.05, "recency": 0.10, "goal_prox": 0.10, "oq_boost": 0.08, "narrative": 0.08, "working_mode": 0.08, "frequency": 0.06},
    "recency-heavy": {"semantic": 0.20, "graph_walk": 0.10, "recency": 0.30, "goal_prox": 0.10, "oq_boost": 0.10, "narrative": 0.05, "working_mode": 0.10, "frequency": 0.05},
    "goal-focused": {"semantic": 0.20, "graph_walk": 0.10, "recency": 0.10, "goal_prox": 0.30, "oq_boost": 0.15, "narrative": 0.05, "working_mode": 0.05, "frequency": 0.05},
    "graph-heavy": {"semantic": 0.20, "graph_walk": 0.25, "recency": 0.10, "goal_prox": 0.10, "oq_boost": 0.10, "narrative": 0.05, "working_mode": 0.10, "frequency": 0.10},
    "balanced": {"semantic": 0.20, "graph_walk": 0.15, "recency": 0.15, "goal_prox": 0.15, "oq_boost": 0.10, "narrative": 0.05, "working_mode": 0.15, "frequency": 0.05},
}

BASE_THRESHOLDS = {"memo_search": 0.45, "graph": 0.50, "narrative": 0.40, "open_question": 0.35, "peripheral": 0.55, "patterns": 0.45, "identity": 0.30, "session_buffer": 0.70, "relevant_context": 0.30}
PRIORITY = {"memo_search": 1, "graph": 2, "narrative": 3, "open_question": 4, "relevant_context": 5, "patterns": 6, "peripheral": 7, "identity": 8, "session_buffer": 9}
TOKEN_CAPS = {"memo_search": 500, "graph": 600, "narrative": 400, "open_question": 200, "relevant_context": 500, "patterns": 300, "peripheral": 200, "identity": 150, "session_buffer": 200}
BUDGETS = {"trivial": 1000, "simple": 1500, "moderate": 2000, "complex": 3000}
SOURCE_CONFIDENCE = {"graph": 0.55, "narrative": 0.50, "peripheral": 0.45, "patterns": 0.50, "identity": 0.40, "relevant_context": 0.45}
