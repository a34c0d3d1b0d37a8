"""Extraction rules as data.

Patterns stay in the common subset of Java and RE2 expressions (no look-around,
no back references), so the same text runs on Spark and on the checking engine.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A line pattern; ``groups`` lists the capture groups to return (0 = whole match)."""

    kind: str
    pattern: str
    groups: tuple[int, ...] = (1,)


# --- fixed values: patterns, word lists and names the results depend on --------

ROUTE_RULES = {
    "react": [
        Rule("react-jsx", r"""(?i)<Route\s+path=["']([^"']+)["'].*?element=\{<([^>]+)\s*/?>\}""", (1, 2)),
        Rule("react-object", r"""(?i)path:\s*["']([^"']+)["']\s*,\s*element:\s*<(\w+)""", (1, 2)),
        Rule("react-simple", r"""(?i)<Route[^>]*path=["']([^"']+)["'][^>]*>""", (1,)),
    ],
    "vue": [
        Rule("vue-component", r"""(?i)path:\s*["']([^"']+)["']\s*,\s*component:\s*(\w+)""", (1, 2)),
        Rule("vue-name", r"""(?i)path:\s*["']([^"']+)["']\s*,\s*name:\s*["']([^"']+)["']""", (1, 2)),
    ],
}
NEXT_PAGE = r"pages[\\/](\w+)\.tsx?"
NEXT_APP = r"app[\\/](\w+)[\\/]page\.tsx?"

UI_RULES = [
    Rule("click", r"onClick=\{([^}]+)\}"),
    Rule("click", r"onClick=\{\s*\(\s*\)\s*=>\s*([^}]+)\}"),
    Rule("click", r'@click="([^"]+)"'),
    Rule("click", r"handleClick\w*\s*[=(]", (0,)),
    Rule("click", r"onPress=\{([^}]+)\}"),
    Rule("submit", r"onSubmit=\{([^}]+)\}"),
    Rule("submit", r'@submit="([^"]+)"'),
    Rule("submit", r"handleSubmit\w*\s*[=(]", (0,)),
    Rule("submit", r"onSubmit=\{\s*async\s*\([^)]*\)\s*=>\s*([^}]+)\}"),
    Rule("fetch", r"""(fetch|axios|request)\s*\(\s*["']([^"']+)["']""", (2, 1)),
    Rule("fetch", r"""api\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""", (2, 1)),
    Rule("fetch", r"""useQuery\(["']([^"']+)["']"""),
    Rule("fetch", r"""useMutation\(["']([^"']+)["']"""),
    Rule("fetch", r"""\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""", (2, 1)),
    Rule("navigation", r"""navigate\(["']([^"']+)["']"""),
    Rule("navigation", r"""router\.push\(["']([^"']+)["']"""),
    Rule("navigation", r"""history\.push\(["']([^"']+)["']"""),
    Rule("navigation", r"""Link\s+to=["']([^"']+)["']"""),
    Rule("navigation", r"""<Link\s+href=["']([^"']+)["']"""),
    Rule("state", r"useState<(\w+)>\s*\(\s*([^)]*)\)", (1, 2)),
    Rule("state", r"const\s+\[(\w+),\s*set(\w+)\]\s*=\s*useState", (1, 2)),
    Rule("state", r"useSelector\(([^)]+)\)"),
    Rule("state", r"useStore\(([^)]+)\)"),
]
UI_NAMES = {
    "delete": "删除", "remove": "移除", "edit": "编辑", "update": "更新", "save": "保存", "submit": "提交",
    "cancel": "取消", "add": "新增", "create": "创建", "search": "搜索", "filter": "筛选", "export": "导出",
    "import": "导入", "load": "加载", "fetch": "获取", "refresh": "刷新", "reset": "重置", "copy": "复制",
    "download": "下载", "upload": "上传", "login": "登录", "logout": "登出", "register": "注册",
    "toggle": "切换", "select": "选择", "close": "关闭", "open": "打开", "show": "显示", "hide": "隐藏",
    "expand": "展开", "collapse": "折叠", "sort": "排序", "paginate": "分页", "navigate": "导航",
}
UI_FETCH_NAME, UI_STATE_NAME, UI_NAVIGATION_NAME = "数据获取", "状态管理", "页面导航"
UI_DESCRIPTIONS = {
    "click": "按钮点击: ",
    "submit": "表单提交: ",
    "fetch": "API调用: ",
    "navigation": "导航到: ",
    "state": "状态定义: ",
}

API_CALL_RULES = [
    Rule("GET", r"""(?i)fetch\(\s*["']([^"']+)["']"""),
    Rule("match", r"""(?i)fetch\(\s*["']([^"']+)["']\s*,\s*\{[^}]*method:\s*["'](\w+)["']""", (1, 2)),
    Rule("match", r"""(?i)axios\.(\w+)\(\s*["']([^"']+)["']""", (2, 1)),
    Rule("match", r"""(?i)api\.(\w+)\(\s*["']([^"']+)["']""", (2, 1)),
    Rule("match", r"""(?i)request\.(\w+)\(\s*["']([^"']+)["']""", (2, 1)),
    Rule("jquery", r"""(?i)\$(?:get|post|put|delete|patch)\(\s*["']([^"']+)["']"""),
    Rule("GET", r"""(?i)useQuery\(\s*\[["']([^"']+)["']"""),
    Rule("POST", r"""(?i)useMutation\(\s*\[["']([^"']+)["']"""),
    Rule("GET", r"""(?i)queryClient\.fetchQuery\(\s*\[["']([^"']+)["']"""),
    Rule("GET", r"""(?i)swr\(\s*["']([^"']+)["']"""),
    Rule("GET", r"""(?i)useSWR\(\s*["']([^"']+)["']"""),
    Rule("match", r"""(?i)http\.(get|post|put|delete|patch)\(\s*["']([^"']+)["']""", (2, 1)),
    Rule("match", r"""(?i)(\w+)\.(get|post|put|delete|patch)\(\s*["']([^"']+)["']""", (3, 2)),
]
BASE_URL_PATTERNS = [
    r"""baseURL\s*[:=]\s*["']([^"']+)["']""",
    r"""BASE_URL\s*[:=]\s*["']([^"']+)["']""",
    r"""API_URL\s*[:=]\s*["']([^"']+)["']""",
]
CONTEXT_PATTERNS = [
    r"(?:async\s+)?function\s+(\w+)",
    r"const\s+(\w+)\s*=\s*(?:async\s*)?\(",
    r"(\w+)\s*\([^)]*\)\s*\{",
]
PARAM_BLOCKS = [r"params:\s*\{([^}]+)\}", r"query:\s*\{([^}]+)\}", r"data:\s*\{([^}]+)\}", r"body:\s*\{([^}]+)\}"]
BODY_LITERAL = r"(?:body|data):\s*(\{[^}]+\})"

ENDPOINT_RULES = {
    "fastapi": Rule("fastapi", r"""(?i)@(router|app)\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""", (3, 2)),
    "flask": Rule("flask", r"""(?i)@(\w+)\.route\(["']([^"']+)["'].*methods\s*=\s*\[([^\]]+)\]""", (2, 3)),
    "express": Rule("express", r"""(?i)(app|router)\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""", (3, 2)),
    "spring": Rule(
        "spring",
        r"""@(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)\s*\(["']([^"']+)["']""",
        (2, 1),
    ),
}
SPRING_METHODS = {
    "GetMapping": "GET",
    "PostMapping": "POST",
    "PutMapping": "PUT",
    "DeleteMapping": "DELETE",
    "PatchMapping": "PATCH",
    "RequestMapping": "GET",
}
ROUTER_PREFIXES = [
    r"""include_router\([^,]+,\s*prefix\s*=\s*["']([^"']+)["']""",
    r"""APIRouter\([^)]*prefix\s*=\s*["']([^"']+)["']""",
]
AUTH_INDICATORS = [
    "Depends(get_current_user)", "Depends(get_current_user_required)", "@login_required", "@require_auth",
    "auth_required", "current_user", "jwt_required", "OAuth2", "HTTPBearer",
]
API_VERSION_PARTS = ["api", "v1", "v2"]
API_CANDIDATE_DIRS = ["api", "routes", "routers", "controllers", "src/api", "app/api"]
API_CANDIDATE_WORDS = ["api", "route", "router", "controller"]
API_CANDIDATE_EXTENSIONS = ["py", "js", "ts"]

SQLALCHEMY_CLASS = r"class\s+(\w+)\(.*(?:Base|Model).*\):"
SQLALCHEMY_TABLE = r"""__tablename__\s*=\s*["']([^"']+)["']"""
SQLALCHEMY_COLUMN = r"(\w+)\s*=\s*Column\(([^)]+)\)"
SQLALCHEMY_TYPE = r"(\w+)(?:\(|$)"
SQLALCHEMY_DEFAULT = r"default\s*=\s*([^,\)]+)"
SQLALCHEMY_FK = r"""ForeignKey\(["']([^"']+)["']"""
PRISMA_MODEL = r"model\s+(\w+)\s*\{([^}]+)\}"
PRISMA_FIELD = r"^(\w+)\s+(\w+)"
TYPEORM_ENTITY = r"""^\s*@Entity\(["']?([^"'\)]*)["']?\)\s*(?:@\w+\([^)]*\)\s*)*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"""
#: From an entity's decorator to the closing brace of its class.
TYPEORM_BODY = r"(?s)^(.*?)(?:\n\}|\z)"
TYPEORM_COLUMN = r"@Column\(([^)]*)\)\s*(?:\w+\s*:\s*)?(\w+)(?:\s*:\s*)?(\w+)?"
TYPEORM_PRIMARY = r"@PrimaryGeneratedColumn\(([^)]*)\)\s*(?:\w+\s*:\s*)?(\w+)"
DJANGO_CLASS = r"class\s+(\w+)\(.*(?:models\.Model|Model)\):"
DJANGO_FIELD = r"(\w+)\s*=\s*models\.(\w+)(?:Field)?\(([^)]*)\)"
MONGOOSE_MODEL = r"""(?:const|let|var)\s+(\w+)\s*=\s*(?:mongoose\.)?model\(["']([^"']+)["']"""
MONGOOSE_SCHEMA = r"(?:const|let|var)\s+{name}Schema\s*=\s*new\s+Schema\(([^)]+)\)"
MONGOOSE_FIELD = r"(\w+):\s*\{[^}]*type:\s*(\w+)"

FEATURE_PATTERNS = {
    "scheduled_task": [
        r"@scheduler\.task", r"@celery\.task", r"@celery\.app\.task", "APScheduler", r"schedule\.every\(",
        r"cron\.schedule", "node-cron", "node-schedule", "@Scheduled", "@EnableScheduling", "setInterval",
        "setTimeout",
    ],
    "sso": [
        "flask_sso", "django-allauth", "authlib", "python-saml", "passport-saml", "passport-oauth2", "OAuth2",
        "OIDC", "OpenID", "SAML", "CasAuthenticationProvider", "@EnableOAuth2Sso",
    ],
    "middleware": [
        "@middleware", r"class\s+\w+Middleware", r"app\.use\(", "add_middleware", "CORSMiddleware",
        "AuthenticationMiddleware", "SessionMiddleware", "@Component.*Middleware",
    ],
    "cache": [
        "redis", r"Redis\(", "memcached", "MemcachedClient", "cachetools", "@cache", "@Cacheable",
        "@CacheEvict", "CacheManager", "node-cache",
    ],
    "message_queue": [
        "celery", r"Celery\(", "rabbitmq", "pika", "kafka", "KafkaConsumer", "KafkaProducer", "bull", "bullmq",
        "@RabbitListener", "@KafkaListener", "JmsTemplate",
    ],
    "database": [
        "sqlalchemy", "SQLAlchemy", "create_engine", "sessionmaker", "mongoose", "MongoClient", "psycopg2",
        "pg", "mysql", "MySQLdb", "DataSource", "@Entity", "JpaRepository", "@Repository",
    ],
    "websocket": [
        "WebSocket", "websocket", "SocketIO", r"socket\.io", "@WebSocket", "@ServerEndpoint",
        "WebSocketHandler", "useWebSocket",
    ],
    "auth": [
        "JWT", "jwt", "jsonwebtoken", "OAuth2PasswordBearer", "Passport", "passport", "bcrypt", "argon2",
        "AuthenticationManager", "@PreAuthorize", "@Secured",
    ],
    "logging": [
        r"logging\.getLogger", "winston", "log4js", "pino", "@Slf4j", "Logger", "LoggerFactory", "LogManager",
    ],
    "monitoring": [
        "prometheus", "Prometheus", "grafana", "datadog", "sentry", "Sentry", "newrelic", "@Timed", "@Metered",
        "Micrometer", "opentelemetry",
    ],
    "email": [
        "smtplib", "SMTP", "sendgrid", "SendGrid", "mailgun", "nodemailer", "JavaMailSender", "@Email",
    ],
    "storage": [
        "boto3", "aws-sdk", "AWS", "S3", "azure-storage", "google-cloud-storage", "minio", "MinioClient",
        "@StorageService",
    ],
}
FEATURE_NAME_PATTERNS = {
    "scheduled_task": [
        r"@scheduler\.task.*?def\s+(\w+)",
        r"@celery\.task.*?def\s+(\w+)",
        r"def\s+(\w+)\s*\([^)]*\)\s*.*@scheduler",
        r"@Scheduled.*?public\s+\w+\s+(\w+)",
    ],
    "middleware": [r"class\s+(\w+Middleware)", r"@middleware\s*\n\s*def\s+(\w+)"],
    "cache": [
        r"""redis\.Redis\([^)]*host\s*=\s*["']([^"']+)["']""",
        r"""Redis\([^)]*host\s*=\s*["']([^"']+)["']""",
    ],
    "message_queue": [r"""Celery\(['"]([^'"]+)['"]""", r"""@RabbitListener\(queues\s*=\s*["']([^"']+)["']"""],
    "database": [r"""create_engine\(["']([^"']+)["']""", r"""mongoose\.connect\(["']([^"']+)["']"""],
    "websocket": [r"""@ServerEndpoint\(["']([^"']+)["']""", r"""WebSocket\(["']([^"']+)["']"""],
    "auth": [r"""OAuth2PasswordBearer\([^)]*tokenUrl\s*=\s*["']([^"']+)["']"""],
    "logging": [r"""logging\.getLogger\(["']([^"']+)["']""", r"LoggerFactory\.getLogger\((\w+)\.class\)"],
    "monitoring": [r"""sentry_sdk\.init\([^)]*dsn\s*=\s*["']([^"']+)["']"""],
    "email": [r"""smtplib\.SMTP\(["']([^"']+)["']"""],
    "storage": [r"""boto3\.client\(["'](\w+)["']"""],
}
FEATURE_CONFIG = {
    "host": r"""host\s*[:=]\s*["']([^"']+)["']""",
    "port": r"port\s*[:=]\s*(\d+)",
    "url": r"""url\s*[:=]\s*["']([^"']+)["']""",
}
FRAMEWORK_PATTERNS = {
    "fastapi": ["from fastapi", "import fastapi", r"FastAPI\("],
    "flask": ["from flask", "import flask", r"Flask\("],
    "django": ["from django", "import django", "DJANGO_SETTINGS"],
    "express": [r"express\(\)", r"""require\(['"]express['"]\)""", """from ['"]express['"]"""],
    "nestjs": ["@Module", "@Controller", "@Injectable"],
    "spring": ["@SpringBootApplication", "@RestController", "@Service"],
    "react": ["from react", """import.*from ['"]react['"]""", r"React\.Component"],
    "vue": ["from vue", """import.*from ['"]vue['"]""", "createApp"],
    "nextjs": ["from next", """import.*from ['"]next['"]"""],
}

TECH_MARKERS = {
    "Python": ["requirements.txt", "setup.py", "pyproject.toml", "Pipfile"],
    "JavaScript": ["package.json"],
    "TypeScript": ["tsconfig.json"],
    "Go": ["go.mod"],
    "Java": ["pom.xml", "build.gradle"],
    "Rust": ["Cargo.toml"],
    "Vue": ["vue.config.js"],
}
TECH_PACKAGES = {"react": "React", "react-dom": "React", "vue": "Vue", "next": "Next.js", "express": "Express"}
TECH_REQUIREMENTS = {"django": "Django", "fastapi": "FastAPI", "flask": "Flask"}
