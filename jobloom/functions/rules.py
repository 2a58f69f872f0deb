"""Rule tables that operators compile into column expressions. All are parameters of the operators; the
values below are fixed values that results depend on, in the order in which they are tried."""

# Technology keys, patterns (case is ignored) and display names.
TECHNOLOGIES = [
    ("java", r"(?<![\w])java(?![\w])(?!script)", "Java"),
    ("python", r"(?<![\w])python(?![\w])", "Python"),
    ("javascript", r"(?<![\w])javascript(?![\w])|\bjs\b", "JavaScript"),
    ("typescript", r"(?<![\w])typescript(?![\w])|\bts\b", "TypeScript"),
    ("csharp", r"(?<![\w])c\#|csharp|\.net|dotnet", "C#"),
    ("go", r"(?<![\w])golang(?![\w])|\bgo\b", "Go"),
    ("rust", r"(?<![\w])rust(?![\w])", "Rust"),
    ("kotlin", r"(?<![\w])kotlin(?![\w])", "Kotlin"),
    ("swift", r"(?<![\w])swift(?![\w])", "Swift"),
    ("ruby", r"(?<![\w])ruby(?![\w])", "Ruby"),
    ("php", r"(?<![\w])php(?![\w])", "PHP"),
    ("scala", r"(?<![\w])scala(?![\w])", "Scala"),
    ("react native", r"react\s*native", "React Native"),
    ("react", r"(?<![\w])react(?:js)?(?![\w])", "React"),
    ("angular", r"(?<![\w])angular(?:js)?(?![\w])", "Angular"),
    ("vue", r"(?<![\w])vue(?:js)?(?![\w])", "Vue"),
    ("svelte", r"(?<![\w])svelte(?:kit)?(?![\w])", "Svelte"),
    ("nextjs", r"(?<![\w])next\.?js(?![\w])", "Next.js"),
    ("spring boot", r"spring\s*boot|spring\s*mvc|\bspring\b", "Spring Boot"),
    ("node", r"(?<![\w])node(?:js|\.js)?(?![\w])", "Node.js"),
    ("express", r"(?<![\w])express(?:js)?(?![\w])", "Express"),
    ("django", r"(?<![\w])django(?![\w])", "Django"),
    ("flask", r"(?<![\w])flask(?![\w])", "Flask"),
    ("fastapi", r"(?<![\w])fastapi(?![\w])", "FastAPI"),
    ("rails", r"(?<![\w])rails|ruby on rails", "Ruby on Rails"),
    ("laravel", r"(?<![\w])laravel(?![\w])", "Laravel"),
    ("aws", r"(?<![\w])aws(?![\w])|amazon web services", "AWS"),
    ("azure", r"(?<![\w])azure(?![\w])", "Azure"),
    ("gcp", r"(?<![\w])gcp(?![\w])|google cloud", "GCP"),
    ("kubernetes", r"kubernetes|\bk8s\b", "Kubernetes"),
    ("docker", r"(?<![\w])docker(?![\w])", "Docker"),
    ("terraform", r"(?<![\w])terraform(?![\w])", "Terraform"),
    ("ansible", r"(?<![\w])ansible(?![\w])", "Ansible"),
    ("jenkins", r"(?<![\w])jenkins(?![\w])", "Jenkins"),
    ("postgresql", r"postgresql|postgres", "PostgreSQL"),
    ("mysql", r"(?<![\w])mysql(?![\w])", "MySQL"),
    ("mongodb", r"mongodb|\bmongo\b", "MongoDB"),
    ("redis", r"(?<![\w])redis(?![\w])", "Redis"),
    ("oracle", r"(?<![\w])oracle(?![\w])", "Oracle DB"),
    ("cassandra", r"(?<![\w])cassandra(?![\w])", "Cassandra"),
    ("elasticsearch", r"elasticsearch|\belastic\b", "Elasticsearch"),
    ("kafka", r"(?<![\w])kafka(?![\w])", "Kafka"),
    ("rabbitmq", r"rabbitmq", "RabbitMQ"),
    ("sqs", r"(?<![\w])sqs(?![\w])", "AWS SQS"),
    ("selenium", r"(?<![\w])selenium(?![\w])", "Selenium"),
    ("playwright", r"(?<![\w])playwright(?![\w])", "Playwright"),
    ("cypress", r"(?<![\w])cypress(?![\w])", "Cypress"),
    ("junit", r"(?<![\w])junit(?![\w])", "JUnit"),
    ("testng", r"(?<![\w])testng(?![\w])", "TestNG"),
    ("pytest", r"(?<![\w])pytest(?![\w])", "pytest"),
    ("cucumber", r"cucumber|gherkin|\bbdd\b", "Cucumber"),
    ("appium", r"(?<![\w])appium(?![\w])", "Appium"),
    ("postman", r"(?<![\w])postman(?![\w])", "Postman"),
    ("oauth", r"(?<![\w])oauth\d?(?![\w])|\boidc\b", "OAuth"),
    ("saml", r"(?<![\w])saml(?![\w])", "SAML"),
    ("keycloak", r"(?<![\w])keycloak(?![\w])", "Keycloak"),
    ("auth0", r"(?<![\w])auth0(?![\w])", "Auth0"),
    ("pytorch", r"(?<![\w])pytorch(?![\w])", "PyTorch"),
    ("tensorflow", r"(?<![\w])tensorflow(?![\w])", "TensorFlow"),
    ("airflow", r"(?<![\w])airflow(?![\w])", "Apache Airflow"),
    ("dbt", r"(?<![\w])dbt(?![\w])", "dbt"),
    ("spark", r"(?<![\w])spark(?![\w])", "Apache Spark"),
    ("snowflake", r"(?<![\w])snowflake(?![\w])", "Snowflake"),
]

# Flag columns and the keys that set them.
TECH_FLAGS = {
    "has_java": ["java"],
    "has_python": ["python"],
    "has_javascript": ["javascript"],
    "has_typescript": ["typescript"],
    "has_csharp": ["csharp"],
    "has_react": ["react", "react native"],
    "has_angular": ["angular"],
    "has_node": ["node"],
    "has_spring_boot": ["spring boot"],
    "has_selenium": ["selenium"],
    "has_playwright": ["playwright"],
    "has_aws": ["aws"],
    "has_azure": ["azure"],
    "has_kubernetes": ["kubernetes"],
    "has_docker": ["docker"],
    "has_postgresql": ["postgresql"],
}

# Title patterns and canonical titles.
TITLES = [
    (r"\b(sdet|sdets?\s+engineer|sdet\s+test\s+engineer)\b", "QA Automation Engineer"),
    (r"\bautomation\s+qa\b|\bqa\s+automation\b", "QA Automation Engineer"),
    (r"\bqa\s+test\s+engineer\b|\btest\s+engineer\b", "QA Engineer"),
    (r"\bquality\s+assurance\s+engineer\b", "QA Engineer"),
    (r"\b(machine\s+learning|ml)\s+engineer\b", "Machine Learning Engineer"),
    (r"\b(devops|site\s+reliability|sre|platform)\s+engineer\b", "DevOps Engineer"),
    (r"\b(front[-\s]?end|fe)\s+(developer|engineer)\b", "Frontend Engineer"),
    (r"\b(back[-\s]?end|be)\s+(developer|engineer)\b", "Backend Engineer"),
    (r"\bfull[-\s]?stack\s+(developer|engineer)\b", "Full-stack Engineer"),
    (r"\bsoftware\s+(developer|engineer)\b", "Software Engineer"),
    (r"\b(cloud|cloud\s+ops)\s+engineer\b", "Cloud Engineer"),
    (r"\bdata\s+engineer\b", "Data Engineer"),
    (r"\bdata\s+scientist\b", "Data Scientist"),
    (r"\bmobile\s+(developer|engineer)\b", "Mobile Engineer"),
    (r"\bios\s+(developer|engineer)\b", "iOS Engineer"),
    (r"\bandroid\s+(developer|engineer)\b", "Android Engineer"),
    (r"\bcyber\s*security\s+engineer\b", "Cybersecurity Engineer"),
]
SENIOR_WORDS = r"\b(senior|sr\.?|junior|jr\.?|lead|principal|staff)\b"
PLACE_TAIL = r"\bin\b\s+(dubai|abu\s*dhabi|sharjah|ajman|uae|united\s+arab\s+emirates).*$"
COMPANY_NOISE = (
    r"\s*(\b(L\.?L\.?C|LLC|FZE|FZ-?LLC|FZCO|FZ|Gulf|UAE|Middle East|MENA|International|Group|Holdings?|Limited|Ltd\.?|Co\.?|Company|Corp\.?|Corporation|Inc\.?)\b\.?,?\s*)+$"
)

# Seniority classes and their words.
SENIORITY = [
    ("architect", "architect"),
    ("manager", "engineering manager|head of|director"),
    ("lead", "lead|principal|staff"),
    ("senior", r"senior|sr\.?"),
    ("junior", r"junior|jr\.?|entry|graduate"),
    ("intern", "intern(ship)?"),
]

# Codes, names and the order in which places are looked for.
EMIRATES = [
    ("dubai", "dubai", "Dubai"),
    ("abu dhabi", "abu_dhabi", "Abu Dhabi"),
    ("sharjah", "sharjah", "Sharjah"),
    ("ajman", "ajman", "Ajman"),
    ("ras al khaimah", "ras_al_khaimah", "Ras Al Khaimah"),
    ("fujairah", "fujairah", "Fujairah"),
    ("umm al quwain", "umm_al_quwain", "Umm Al Quwain"),
]
CITY_ORDER = ["abu dhabi", "ras al khaimah", "umm al quwain", "dubai", "sharjah", "ajman", "fujairah"]
UAE_MENTIONS = ["united arab emirates", " uae ", "(uae)", "uae,", ", uae", "dubai", "abu dhabi", "sharjah", "ajman", "ras al khaimah", "fujairah", "umm al quwain"]

# Categories and their substrings.
CATEGORIES = [
    ("mobile", ["ios developer", "android developer", "mobile developer", "mobile engineer", "react native", "flutter", "swift", "kotlin", "xamarin", "objective-c", " ios ", " android "]),
    ("qa", ["qa ", "quality assurance", "sdet", "test engineer", "test automation", "automation engineer", "tester", "test analyst", " testing"]),
    ("devops", ["devops", "site reliability", " sre ", "platform engineer", "cloud engineer", "cloud architect", "infrastructure engineer", "kubernetes", "terraform", "release engineer", "build engineer", "finops"]),
    ("security", ["security engineer", "appsec", "devsecops", "soc analyst", "soc engineer", "penetration", "pentest", "cyber", "infosec", "ciso", "security analyst"]),
    ("data_ml", ["data engineer", "data scientist", "data analyst", "analytics engineer", "machine learning", " ml engineer", "ai engineer", "mlops", "bi engineer", "business intelligence", "data architect"]),
    ("product_design", ["product manager", "product owner", "ux designer", "ui designer", "product designer", "ux researcher", "graphic designer", "interaction designer"]),
    ("fullstack", ["full stack", "full-stack", "fullstack", "mern", "mean stack"]),
    ("frontend", ["frontend", "front end", "front-end", "ui developer", "ui engineer", "react developer", "angular developer", "vue developer", "javascript developer"]),
    ("backend", ["backend", "back end", "back-end", "java developer", "node developer", "python developer", ".net developer", "golang developer", "go developer", "api developer", "microservices", "server-side", "spring boot", "ruby developer", "php developer"]),
    ("it_support", ["system administrator", "sysadmin", "network engineer", "it support", "help desk", "service desk", "desktop support", "it administrator"]),
]

# Scoring and rejection patterns.
TECH_DOMAIN = (
    r"\b(it|ict|qa|automation|sdet|tester|software|backend|frontend|full[-\s]?stack|devops|sre|platform|cloud|data|machine learning|ml|ai|security|cyber|"
    r"mobile\s+(?:app|apps|application|applications|developer|engineer|development)|ios|android|architect|engineer|developer|programmer)\b"
)
STRONG_NEGATIVE = (
    r"\b(cashier|receptionist|bank teller|nurse|pharmacist|real estate agent|recruiter|talent acquisition|civil engineer|mechanical engineer|electrical engineer|"
    r"truck driver|delivery driver|delivery boy|food delivery|chef|cook|waiter|barista|housekeep|lawyer|paralegal|teacher|tutor)\b"
)
TRADE = r"\b(crane|forklift|mechanics?|electrician|plumber|carpenter|welder|mason|scaffold(?:er|ing)?|construction|quantity surveyor|hvac|piping)\b"
TRADE_OVERRIDE = r"\b(software|cloud|developer|devops|data|cyber|security|qa|erp|sap|platform|application|app|digital|ai|ml|it|ict)\b"
UAE_PLACE = r"united arab emirates|\buae\b|dubai|abu\s*dhabi|sharjah|ajman|ras\s*al\s*khaimah|fujairah|umm\s*al\s*quwain"
OTHER_COUNTRY = (
    r"\b(indonesia|india|pakistan|philippines|nigeria|kenya|egypt|bangladesh|sri lanka|nepal|vietnam|thailand|malaysia|singapore|saudi arabia|qatar|bahrain|oman|kuwait|jordan|lebanon|iraq|"
    r"germany|france|uk|united kingdom|canada|australia|united states|\busa\b|china|japan|south korea|brazil|mexico|south africa|turkey|russia|poland|ukraine|romania)\b"
)
_EU_MONEY = ("€", "£", r"eur\b", r"gbp\b", r"\b\d+[,.]?\d*k?\s*/\s*(?:year|yr|annum|month)\s*(?:eur|gbp|€|£)")
_EU_PLACE = (r"authorized?\s+to\s+work\s+in\s+(?:the\s+)?(?:eu|europe|uk|united\s+kingdom|emea)", r"\blocation\s*:\s*(?:emea|europe|eu\b|remote\s+emea|remote\s+europe)")
#: The alternatives of EU_SCOPE.
EU_SCOPES = (*_EU_MONEY, *_EU_PLACE)
EU_SCOPE = "(?:" + "|".join(f"(?:{p})" for p in ("|".join(_EU_MONEY), *_EU_PLACE)) + ")"
GENERIC_REMOTE = "remote (uae-friendly)"
SENIOR_SIGNAL = r"\A.*\b(senior|lead|principal|junior|staff|intern)\b.*\z"
MIN_SCORE = 40

# Hosts that are not the employer's, and employers by the start of their name.
NOT_EMPLOYERS = [
    "linkedin.com", "indeed.com", "glassdoor.com", "ziprecruiter.com", "monster.com", "careerjet.com", "jooble.org", "simplyhired.com", "bayt.com", "naukrigulf.com", "gulftalent.com", "dubizzle.com",
    "jobs.ae", "khaleejiah.com", "gulf-talent.com", "lever.co", "greenhouse.io", "workday.com", "smartrecruiters.com", "taleo.net", "bamboohr.com", "breezy.hr", "jobvite.com", "workable.com",
    "icims.com", "successfactors.com", "myworkdayjobs.com", "oraclecloud.com", "ashbyhq.com", "applytojob.com", "recruitee.com", "teamtailor.com", "adzuna.com", "remoteok.com", "remoteok.io", "himalayas.app",
]
EMPLOYERS = {
    "emirates": "emirates.com", "emirates nbd": "emiratesnbd.com", "emirates islamic": "emiratesislamic.ae", "etisalat": "etisalat.ae", "du ": "du.ae", "adnoc": "adnoc.ae", "mashreq": "mashreqbank.com",
    "first abu dhabi bank": "bankfab.com", "fab ": "bankfab.com", "g42": "g42.com", "inception": "inceptionai.ai", "dewa": "dewa.gov.ae", "rta": "rta.ae", "dubai airports": "dubaiairports.ae",
    "dubai holding": "dubaiholding.com", "majid al futtaim": "majidalfuttaim.com", "careem": "careem.com", "noon": "noon.com", "talabat": "talabat.com", "amazon": "amazon.com", "microsoft": "microsoft.com",
    "google": "google.com", "oracle": "oracle.com", "ibm": "ibm.com", "accenture": "accenture.com", "deloitte": "deloitte.com", "pwc": "pwc.com", "kpmg": "kpmg.com", "ey ": "ey.com",
}

# Publishers by substring.
PUBLISHERS = [
    ("linkedin", "LinkedIn"),
    ("indeed", "Indeed"),
    ("bayt", "Bayt"),
    ("gulftalent", "GulfTalent"),
    ("naukrigulf", "Naukrigulf"),
    ("glassdoor", "Glassdoor"),
    ("ziprecruiter", "ZipRecruiter"),
    ("monster", "Monster"),
    ("bebee", "BeBee"),
]
AGGREGATORS = r"(linkedin\.com|indeed\.com|naukrigulf\.com|bayt\.com|gulftalent\.com|glassdoor\.com|monster\.|adzuna\.)"
AGGREGATORS_WIDE = (
    r"(jooble|talent\.com|talent\.ae|jobsora|jobsite|whatjobs|hipo\.|jobleads|ziprecruiter|simplyhired|trovit|jobomas|laimoon|careerjet|snaphunt|joboptions|jobg8|jobserve|adview|monster\.|glassdoor|"
    r"linkedin\.com|indeed\.com|naukri|bayt\.|gulftalent|adzuna|remoteok|himalayas|workable\.com|lever\.co|greenhouse\.io|joblum|allthetopbananas|hireahire)"
)

# Labels of the company directory.
DIRECTORY_CATEGORIES = {
    "backend": "Software & Product", "frontend": "Software & Product", "fullstack": "Software & Product", "mobile": "Software & Product", "qa": "Software & Product", "devops": "Cloud & DevOps", "cloud": "Cloud & DevOps",
    "data": "Data & AI", "ai": "Data & AI", "security": "Cybersecurity", "erp": "Enterprise IT", "support": "Enterprise IT",
}
DIRECTORY_CITIES = {
    "dubai": "Dubai", "abu_dhabi": "Abu Dhabi", "abu dhabi": "Abu Dhabi", "sharjah": "Sharjah", "ajman": "Ajman", "ras_al_khaimah": "Ras Al Khaimah", "fujairah": "Fujairah", "umm_al_quwain": "Umm Al Quwain", "al_ain": "Al Ain",
}

# Headers of description sections.
SECTION_HEADERS = (
    r"About (?:the (?:Role|Company|Position|Team|Job)|Us|You|The Role|The Company|This Role)|(?:Key |Main )?Responsibilities|Job (?:Duties|Description|Summary)|What You(?:'ll| Will) (?:Do|Be Doing)|"
    r"Your (?:Role|Responsibilities|Main Tasks|Tasks|Profile|Day)|Required (?:Technical )?Skills|Required Skills|Requirements|Key (?:Technical )?Skills|Technical Skills|Skills (?:and|&) (?:Experience|Qualifications)|"
    r"Nice to Have|Bonus(?: Points)?|Plus(?: Points)?|Preferred (?:Qualifications|Skills|Experience)|Qualifications|Experience Required|Domain Experience|Required Competencies|Competencies|(?:What We|We) Offer|"
    r"Benefits|Perks|Compensation|How to Apply|Application Process|Work (?:Location|Environment)|Not a Fit If You"
)
