"""Dimension tables. They are inputs of the operators; these defaults are small and can be replaced by any DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Spelling -> canonical skill; canonical names stand for themselves.
SKILL_ALIASES = {
    # languages
    "js": "javascript", "ts": "typescript", "py": "python", "javascript": "javascript", "typescript": "typescript", "python": "python",
    "c#": "csharp", "c++": "cplusplus", "golang": "go", "go": "go", "objc": "objectivec", "objectivec": "objectivec",
    "vb": "visualbasic", "vbnet": "visualbasic", "ruby": "ruby", "rb": "ruby", "java": "java", "scala": "scala", "kotlin": "kotlin",
    "rust": "rust", "swift": "swift", "dart": "dart", "php": "php", "perl": "perl", "lua": "lua",
    # infrastructure
    "k8s": "kubernetes", "kube": "kubernetes", "kubernetes": "kubernetes", "kubernates": "kubernetes", "kubernatis": "kubernetes",
    "kubernetis": "kubernetes", "dkr": "docker", "docker": "docker", "dockerize": "docker", "terraform": "terraform",
    "terrform": "terraform", "ans": "ansible", "ansible": "ansible", "anisble": "ansible", "jenkin": "jenkins", "jenkins": "jenkins",
    "jenkns": "jenkins", "ci": "continuousintegration", "cd": "continuousdeployment", "cicd": "cicd", "ci/cd": "cicd",
    # clouds
    "aws": "aws", "amazonwebservices": "aws", "gcp": "gcp", "googlecloud": "gcp", "googlecloudplatform": "gcp", "azure": "azure", "msazure": "azure",
    # databases
    "pg": "postgresql", "postgres": "postgresql", "postgre": "postgresql", "postgresql": "postgresql", "postgressql": "postgresql",
    "psql": "postgresql", "mongo": "mongodb", "mongodb": "mongodb", "mongdb": "mongodb", "mysql": "mysql", "sql": "sql",
    "mssql": "mssql", "sqlserver": "mssql", "microsoftsqlserver": "mssql", "dynamodb": "dynamodb", "dynamo": "dynamodb",
    "redis": "redis", "memcached": "memcached", "cassandra": "cassandra", "elasticsearch": "elasticsearch",
    # frameworks
    "react": "reactjs", "reactjs": "reactjs", "react.js": "reactjs", "reactnative": "reactnative", "react native": "reactnative",
    "node": "nodejs", "nodejs": "nodejs", "node.js": "nodejs", "nodjs": "nodejs", "nextjs": "nextjs", "next": "nextjs", "next.js": "nextjs",
    "vue": "vuejs", "vuejs": "vuejs", "vue.js": "vuejs", "angular": "angular", "angularjs": "angular", "django": "django", "djnago": "django",
    "flask": "flask", "flsk": "flask", "fastapi": "fastapi", "fstapi": "fastapi", "springboot": "springboot", "spring": "springboot",
    "spring boot": "springboot", "express": "expressjs", "expressjs": "expressjs", "express.js": "expressjs", "rails": "rubyonrails",
    "ror": "rubyonrails", "rubyonrails": "rubyonrails", "aspnet": "aspnet", "asp.net": "aspnet", "dotnet": "dotnet", ".net": "dotnet",
    # data and learning
    "sklearn": "scikitlearn", "scikitlearn": "scikitlearn", "scikit-learn": "scikitlearn", "ml": "machinelearning",
    "machinelearning": "machinelearning", "dl": "deeplearning", "deeplearning": "deeplearning", "nlp": "nlp",
    "naturallanguageprocessing": "nlp", "ai": "ai", "artificialintelligence": "ai", "cv": "computervision",
    "computervision": "computervision", "pytorch": "pytorch", "torch": "pytorch", "tensorflow": "tensorflow", "tensrflow": "tensorflow",
    "tf": "tensorflow", "pandas": "pandas", "pnds": "pandas", "numpy": "numpy", "np": "numpy", "scipy": "scipy", "keras": "keras",
    "llm": "llm", "largelanguagemodel": "llm", "rag": "rag", "gpt": "gpt", "chatgpt": "gpt",
    # interfaces and tools
    "restapi": "restapi", "rest": "restapi", "restapis": "restapi", "restful": "restapi", "restfulapi": "restapi", "graphql": "graphql",
    "gql": "graphql", "grpc": "grpc", "git": "git", "github": "github", "gitlab": "gitlab", "jira": "jira", "jiira": "jira",
    "figma": "figma", "fgma": "figma", "webpack": "webpack", "vite": "vite", "npm": "npm", "yarn": "yarn", "pnpm": "pnpm",
    # business
    "seo": "seo", "searchengineoptimization": "seo", "sem": "sem", "searchenginemarketing": "sem", "smm": "smm",
    "socialmediamarketing": "smm", "ppc": "ppc", "payperclick": "ppc", "crm": "crm", "customerrelationshipmanagement": "crm",
    "erp": "erp", "enterpriseresourceplanning": "erp", "bi": "bi", "businessintelligence": "bi",
    # security
    "ids": "ids", "intrusiondetectionsystem": "ids", "ips": "ips", "intrusionpreventionsystem": "ips", "siem": "siem",
    "securityinformationeventmanagement": "siem", "vpn": "vpn", "virtualprivatenetwork": "vpn",
    # others
    "agile": "agile", "agil": "agile", "scrum": "scrum", "scurm": "scrum", "devops": "devops", "devop": "devops", "oop": "oop",
    "objectorientedprogramming": "oop", "tdd": "tdd", "testdrivendevelopment": "tdd", "bdd": "bdd", "behaviordrivendevelopment": "bdd",
    "mvc": "mvc", "mvvm": "mvvm",
}
#: Spellings of a keyword that are looked for in texts.
KEYWORD_ALIASES = {
    "microservices": ("microservices", "micro-services", "micro services", "microservice"),
    "backend": ("backend", "back-end", "back end", "server-side", "server side"),
    "frontend": ("frontend", "front-end", "front end", "client-side", "client side"),
    "fullstack": ("fullstack", "full-stack", "full stack"),
    "deployment": ("deployment", "deploy", "deploying", "deployed", "deployments"),
    "scalable": ("scalable", "scalability", "scaling", "scale"),
    "api": ("api", "apis", "rest api", "restful", "web service", "web services", "endpoint"),
    "database": ("database", "databases", "db", "data store", "datastore", "rdbms"),
    "agile": ("agile", "scrum", "kanban", "sprint", "sprints"),
    "server": ("server", "servers", "server-side"),
    "cloud": ("cloud", "cloud-based", "cloud computing", "saas", "paas", "iaas"),
    "devops": ("devops", "dev-ops", "dev ops", "ci/cd", "cicd"),
    "testing": ("testing", "test", "unit test", "unit testing", "integration testing", "qa"),
    "containerization": ("containerization", "containers", "container", "docker", "kubernetes"),
    "monitoring": ("monitoring", "observability", "logging", "alerting"),
    "campaign": ("campaign", "campaigns", "ad campaign", "marketing campaign"),
    "brand": ("brand", "branding", "brand awareness", "brand identity"),
    "content": ("content", "content creation", "content strategy", "content marketing"),
    "traffic": ("traffic", "web traffic", "site traffic", "organic traffic"),
    "conversion": ("conversion", "conversions", "conversion rate", "cro"),
    "strategy": ("strategy", "strategic", "strategies", "strategic planning"),
    "audience": ("audience", "target audience", "demographics", "segmentation"),
    "engagement": ("engagement", "user engagement", "customer engagement"),
    "security": ("security", "cybersecurity", "cyber security", "infosec", "information security"),
    "patrol": ("patrol", "patrolling", "patrols"),
    "monitor": ("monitor", "monitoring", "surveillance", "supervise"),
    "safety": ("safety", "safe", "safety protocols", "workplace safety"),
    "guard": ("guard", "guarding", "security guard", "security officer"),
    "investigation": ("investigation", "investigate", "investigations", "investigative"),
    "compliance": ("compliance", "compliant", "regulatory", "regulations"),
    "web": ("web", "website", "websites", "web application", "web app", "webapp"),
    "responsive": ("responsive", "responsive design", "mobile-friendly", "mobile friendly"),
    "github": ("github", "git", "version control", "source control"),
}
#: A skill implies another (source, target), and skills that are related.
IMPLIES = (
    ("nextjs", "reactjs"), ("nestjs", "nodejs"), ("django", "python"), ("fastapi", "python"), ("flask", "python"),
    ("pytorch", "python"), ("springboot", "java"), ("kotlin", "java"), ("typescript", "javascript"), ("expressjs", "nodejs"),
)
RELATED = (("mysql", "postgresql"), ("reactjs", "vuejs"), ("docker", "kubernetes"), ("tensorflow", "pytorch"))
#: Penalties in percent between domains; a pair that is missing has DEFAULT_PENALTY.
DOMAINS = ("engineering", "legal", "finance", "healthcare", "hr", "marketing", "accounting")
PENALTIES = (
    (0, -80, -70, -80, -60, -50, -70),
    (-80, 0, -30, -60, -25, -70, -30),
    (-70, -30, 0, -70, -50, -50, -10),
    (-80, -60, -70, 0, -50, -70, -70),
    (-60, -25, -50, -50, 0, -30, -40),
    (-50, -70, -50, -70, -30, 0, -60),
    (-70, -30, -10, -70, -40, -60, 0),
)
DEFAULT_PENALTY, DEFAULT_SUB_PENALTY = -50, -30
#: Level of a degree by the first key that the text contains, in this order.
DEGREES = (
    ("phd", 5), ("doctorate", 5), ("ph.d", 5), ("master", 4), ("masters", 4), ("mba", 4), ("m.s", 4), ("m.a", 4), ("msc", 4),
    ("m.sc", 4), ("m.tech", 4), ("mtech", 4), ("bachelor", 3), ("bachelors", 3), ("b.s", 3), ("b.a", 3), ("bsc", 3),
    ("b.sc", 3), ("b.tech", 3), ("btech", 3), ("bca", 3), ("b.e", 3), ("be", 3), ("associate", 2), ("associates", 2),
    ("diploma", 2), ("class 12", 1), ("12th", 1), ("high school", 1), ("class 10", 0), ("10th", 0), ("any", -1), ("none", 0),
)
#: Penalties in percent between branches of engineering; a pair that is missing has DEFAULT_SUB_PENALTY.
SUBDOMAIN_PENALTIES = {
    "backend": {"frontend": -20, "fullstack": 0, "devops": -10, "data": -15, "ml": -20, "mobile": -25, "security": -15, "embedded": -25},
    "frontend": {"backend": -20, "fullstack": 0, "devops": -25, "data": -25, "ml": -30, "mobile": -15, "security": -25, "embedded": -35},
    "fullstack": {"backend": 0, "frontend": 0, "devops": -10, "data": -15, "ml": -20, "mobile": -10, "security": -15, "embedded": -25},
    "devops": {"backend": -10, "frontend": -25, "fullstack": -10, "data": -15, "ml": -25, "mobile": -30, "security": -10, "embedded": -15},
    "data": {"backend": -15, "frontend": -25, "fullstack": -15, "devops": -15, "ml": -5, "mobile": -30, "security": -20, "embedded": -25},
    "ml": {"backend": -20, "frontend": -30, "fullstack": -20, "devops": -25, "data": -5, "mobile": -30, "security": -25, "embedded": -25, "civil": -70, "electrical": -50, "mechanical": -50},
    "civil": {"backend": -70, "frontend": -70, "fullstack": -70, "devops": -60, "data": -60, "ml": -70, "electrical": -30, "mechanical": -25, "software": -70, "embedded": -50},
    "electrical": {"backend": -60, "frontend": -70, "fullstack": -65, "devops": -55, "data": -55, "ml": -50, "civil": -30, "mechanical": -20, "software": -60, "embedded": -10},
    "mechanical": {"backend": -65, "frontend": -70, "fullstack": -65, "devops": -60, "data": -55, "ml": -50, "civil": -25, "electrical": -20, "software": -65, "embedded": -30},
    "software": {"civil": -70, "electrical": -60, "mechanical": -65, "embedded": -25, "backend": 0, "frontend": 0, "fullstack": 0, "devops": -10, "data": -15, "ml": -20},
    "embedded": {"backend": -25, "frontend": -35, "fullstack": -25, "devops": -15, "data": -25, "ml": -25, "civil": -50, "electrical": -10, "mechanical": -30, "software": -25},
}
#: The branch that a title or department names, the first that applies.
TITLE_SUBDOMAINS = (
    ("civil", "civil"), ("structural", "civil"), ("electrical", "electrical"), ("mechanical", "mechanical"), ("frontend", "frontend"),
    ("front-end", "frontend"), ("backend", "backend"), ("back-end", "backend"), ("full stack", "fullstack"), ("fullstack", "fullstack"),
    ("devops", "devops"), ("sre", "devops"), ("data engineer", "data"), ("data scientist", "ml"), ("ml engineer", "ml"),
    ("machine learning", "ml"), ("embedded", "embedded"), ("firmware", "embedded"),
)
#: Keywords of branches of engineering; a small default, any table of this form can be passed.
SUBDOMAIN_KEYWORDS = {
    "civil": ("civil", "structural", "construction", "concrete", "surveying", "autocad", "site engineer", "quantity surveyor"),
    "electrical": ("electrical", "circuit", "voltage", "transformer", "plc", "scada", "switchgear", "wiring"),
    "mechanical": ("mechanical", "solidworks", "catia", "cnc", "manufacturing", "hydraulic", "hvac", "machining"),
    "software": ("python", "javascript", "react", "django", "docker", "aws", "api", "git", "java", "software engineer"),
    "data": ("data engineer", "etl", "spark", "hadoop", "kafka", "airflow", "data warehouse", "sql"),
    "ml": ("machine learning", "deep learning", "tensorflow", "pytorch", "nlp", "computer vision"),
    "frontend": ("frontend", "front-end", "react", "angular", "vue", "css", "html"),
    "backend": ("backend", "back-end", "server-side", "microservices", "database", "rest api", "fastapi", "django", "flask"),
    "devops": ("devops", "sre", "terraform", "ansible", "jenkins", "kubernetes", "ci/cd", "linux"),
    "embedded": ("embedded", "firmware", "rtos", "microcontroller", "fpga", "iot", "arduino"),
}
#: Domains of skills by graph key; the graph itself is an input.
SKILL_DOMAINS = {k: "engineering" for k in ("python", "java", "javascript", "reactjs", "nodejs", "docker", "kubernetes", "postgresql", "django", "flask", "fastapi", "mysql")}
#: Issuers of certificates that count more.
CERTIFICATE_ISSUERS = (
    "google", "aws", "amazon", "microsoft", "azure", "meta", "facebook", "ibm", "oracle", "cisco", "salesforce", "adobe", "nvidia",
    "red hat", "vmware", "hashicorp", "databricks", "snowflake", "coursera", "udacity", "edx", "mit", "stanford", "harvard", "iit",
    "cambridge", "oxford", "comptia", "pmi", "isaca", "isc2", "(isc)2", "hubspot", "hootsuite", "semrush", "moz", "cfa", "frm",
    "chartered", "nist", "sans", "ec-council", "six sigma", "lean", "prince2", "itil",
)
#: Words of contests, and of their prizes.
CONTEST_WORDS = (
    "hackathon", "hack-a-thon", "coding competition", "code competition", "programming contest", "coding challenge",
    "competitive programming", "kaggle", "topcoder", "codeforces", "leetcode", "hackerrank", "datathon", "ideathon", "makeathon", "buildathon",
)
PRIZE_WORDS = (
    "winner", "won", "first place", "1st place", "champion", "gold", "finalist", "runner-up", "runner up", "second place",
    "2nd place", "top 3", "top 5", "top 10", "best project", "grand prize",
)
#: Keywords by which certificates fit a request, by field; a small default.
CERTIFICATE_FIELDS = {
    "it": ("web", "cloud", "devops", "python", "java", "javascript", "react", "docker", "kubernetes", "aws", "azure", "machine learning", "sql", "agile", "scrum"),
    "marketing": ("digital marketing", "seo", "sem", "social media", "google ads", "analytics", "marketing", "campaign"),
    "finance": ("cfa", "frm", "cpa", "acca", "financial", "accounting", "investment", "audit", "tax"),
    "healthcare": ("nursing", "cpr", "first aid", "medical", "clinical", "health", "patient care"),
    "legal": ("law", "legal", "compliance", "regulatory", "contract", "litigation", "paralegal"),
    "hr": ("hr", "human resources", "recruitment", "talent", "payroll"),
}
#: Section headers in lower case, by section.
SECTIONS = {
    "summary": (
        "summary", "profile", "about", "about me", "objective", "overview", "professional summary", "career objective",
        "personal statement", "executive summary", "professional profile", "career summary",
    ),
    "experience": (
        "experience", "employment history", "work experience", "professional experience", "career history", "work history",
        "job history", "relevant experience", "relevant work experience", "employment", "clinical experience",
        "patient care experience", "teaching experience", "legal experience", "practice areas", "deal experience",
        "key accounts", "consulting experience", "military service", "service history", "case management", "internship",
        "internships", "internship and training", "internship & training", "professional training", "industrial training",
        "practical training", "vocational training", "apprenticeship", "apprenticeships",
    ),
    "education": (
        "education", "academic background", "qualifications", "academic history", "educational background", "academics",
        "academic qualifications",
    ),
    "projects": (
        "projects", "personal projects", "open source", "open-source", "project experience", "key projects", "notable projects",
        "portfolio", "side projects", "technical projects", "academic projects", "projects / open-source",
        "projects / open source", "projects/open-source", "projects/open source", "cases", "case studies", "engagements",
        "research work", "research projects", "initiatives", "campaigns", "consulting engagements", "client projects",
    ),
    "skills": (
        "skills", "technical skills", "core competencies", "competencies", "expertise", "technologies", "tools",
        "tools & technologies", "technical expertise", "programming languages", "professional skills", "areas of expertise",
        "specializations", "technical proficiencies", "clinical skills", "therapeutic modalities", "key strengths",
    ),
    "certifications": (
        "certifications", "certificates", "courses", "training", "licenses", "credentials", "professional development",
        "certification", "professional licenses", "bar admissions", "board certifications", "accreditations",
        "continuing education",
    ),
    "languages": ("languages", "language skills", "spoken languages"),
    "awards": ("awards", "honors", "recognitions", "distinctions"),
    "achievements": ("accomplishments", "achievements", "key achievements", "key accomplishments"),
    "publications": ("publications", "research papers", "journal articles", "conference papers", "presentations", "authored works"),
    "references": ("references",),
}
#: The headers in upper case, and the section of each.
SECTION_NAMES = tuple(h.upper() for headers in SECTIONS.values() for h in headers)
SECTION_OF = tuple(s for s, headers in SECTIONS.items() for _ in headers)
#: The part of a record that a section of tagged text goes to, where it has another name.
RECORD_PARTS = {
    "experience": "employment",
    "summary": "profile",
    "certifications": "courses",
    "achievements": "accomplishments",
    "awards": "accomplishments",
}
#: Keywords by domain with weights, for the weighted vote.
DOMAIN_KEYWORDS = {
    "engineering": (("software", 3.0), ("developer", 3.0), ("python", 2.0), ("java", 2.0), ("backend", 2.0), ("cloud", 1.5)),
    "legal": (("lawyer", 3.0), ("attorney", 3.0), ("litigation", 2.5), ("contract law", 2.0), ("compliance", 1.0)),
    "finance": (("investment", 2.5), ("financial analyst", 3.0), ("portfolio", 1.5), ("equity", 2.0)),
    "healthcare": (("nurse", 3.0), ("patient", 2.0), ("clinical", 2.0), ("hospital", 2.0)),
    "hr": (("recruitment", 2.5), ("human resources", 3.0), ("payroll", 1.5), ("onboarding", 1.5)),
    "marketing": (("seo", 2.0), ("brand", 1.5), ("marketing", 3.0), ("campaign", 1.5)),
    "accounting": (("accountant", 3.0), ("bookkeeping", 2.5), ("audit", 2.0), ("tax", 1.5)),
}
#: Companies whose names in an entry earn a bonus.
PRESTIGE_COMPANIES = (
    "google", "alphabet", "meta", "facebook", "apple", "amazon", "microsoft", "netflix", "nvidia", "tesla", "openai", "deepmind",
    "anthropic", "salesforce", "adobe", "oracle", "ibm", "intel", "cisco", "samsung", "palantir", "snowflake", "databricks", "stripe",
    "uber", "airbnb", "linkedin", "twitter", "x corp", "spotify", "shopify", "atlassian", "vmware", "sap", "twilio", "cloudflare",
    "crowdstrike", "datadog", "square", "block", "coinbase", "robinhood", "instacart", "doordash", "lyft", "pinterest", "snap",
    "tiktok", "bytedance", "zoom", "infosys", "tcs", "wipro", "cognizant", "hcl", "tech mahindra", "goldman sachs", "jpmorgan",
    "jp morgan", "morgan stanley", "blackrock", "citadel", "two sigma", "jane street", "bridgewater", "barclays", "deutsche bank",
    "ubs", "credit suisse", "hsbc", "visa", "mastercard", "paypal", "american express", "fidelity", "mckinsey", "bcg", "bain",
    "deloitte", "pwc", "kpmg", "ey", "ernst & young", "accenture", "capgemini", "pfizer", "johnson & johnson", "roche", "novartis",
    "merck", "abbvie", "eli lilly", "astrazeneca", "moderna", "gsk", "walmart", "target", "costco", "nike", "adidas", "macy's",
    "macys", "nordstrom", "best buy", "home depot", "coca-cola", "pepsico", "procter & gamble", "unilever", "l'oreal", "disney",
    "warner bros", "paramount", "sony", "nbc", "cnn", "bbc", "bmw", "mercedes", "toyota", "ford", "general motors", "spacex",
    "boeing", "lockheed martin", "raytheon", "shell", "bp", "chevron", "exxonmobil",
)


def skill_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SKILL_ALIASES.items()), "alias string, canonical string")


def skill_edges(spark: SparkSession) -> DataFrame:
    """src, dst, kind: `implies` as given, `related` both ways."""
    rows = [(a, b, "implies") for a, b in IMPLIES] + [(a, b, "related") for a, b in RELATED] + [(b, a, "related") for a, b in RELATED]
    return spark.createDataFrame(rows, "src string, dst string, kind string")


def domain_penalties(spark: SparkSession) -> DataFrame:
    rows = [(a, b, p) for a, row in zip(DOMAINS, PENALTIES, strict=True) for b, p in zip(DOMAINS, row, strict=True)]
    return spark.createDataFrame(rows, "jd_domain string, cand_domain string, penalty int")


def domain_keywords(spark: SparkSession) -> DataFrame:
    rows = [(d, i, k, w) for i, (d, keys) in enumerate(DOMAIN_KEYWORDS.items()) for k, w in keys]
    return spark.createDataFrame(rows, "domain string, domain_ord int, keyword string, weight double")


def section_headers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h, s) for s, headers in SECTIONS.items() for h in headers], "header string, section string")
