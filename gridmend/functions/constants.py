"""Word lists, patterns and thresholds that decide results.

They have to be exactly these for results to agree with forms already processed.
"""

# --- fixed values: character classes -------------------------------------------------------------------
DIACRITICS = "[ً-ٰٟ]"
WIDE_DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ]"
HEADER_DIACRITICS = "[ً-ٰٟ]"
VALUE_DIACRITICS = "[ً-ْٰ]"
EVAL_DIACRITICS = "[ً-ْـ]"
ALEF_FROM, ALEF_TO = "أإآٱ", "اااا"
YEH_FROM, YEH_TO = "ىئ", "يي"
ARABIC = "[؀-ۿ]"
NOT_ARABIC = "[^؀-ۿ]"
LETTERS = "[؀-ۿݐ-ݿa-zA-Z]"
NOT_LETTERS = "[^؀-ۿݐ-ݿa-zA-Z]"
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"
PERSIAN_FROM, PERSIAN_TO = "یکہے", "يكهي"
CONFUSION_FROM, CONFUSION_TO = "رخج", "دحح"

# --- fixed values: header patterns ---------------------------------------------------------------------
# standardisers
GRID_ID = "(?i)هوية|هويه|بطاقة|الوطني|identity|passport|جواز"
GRID_PHONE = "(?i)رقم|هاتف|جوال|موبايل|phone|tel"
GRID_DATE = "(?i)تاريخ|date"
# text path and validators
KEY_PHONE = "(?i)هاتف|تواصل|جوال|موبايل|phone|mobile|tel"
KEY_DATE = "(?i)تاريخ|ميلاد|ولاد|date|dob|birth"
KEY_NAME = "(?i)اسم|name"
# audit
AUDIT_PRICE = "(?i)سعر|price|unit.?price|وحدة"
AUDIT_QTY = "(?i)كمية|qty|quantity|عدد"
AUDIT_TOTAL = "(?i)مجموع|total|إجمالي|اجمالي"
AUDIT_ID = "(?i)هوية|هويه|identity|id|national"
LOOKS_DATE = "[0-9]{1,4}\\s*[/.\\-]\\s*[0-9]{1,2}\\s*[/.\\-]\\s*[0-9]{1,4}"
AUDIT_DATE_OK = "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"
PHONE_OK = "^(059|056)[0-9]{7}$"
ID_OK = "^[0-9]{9}$"
# fixed choice
CHOICE_GENDER = "(?i)جنس|نوع.{0,8}[اأإآ]جتماع|gender|sex"
CHOICE_APPROVAL = "(?i)موافق|قبول|وافق|توافق"
CHOICE_DISABILITY = "(?i)[اأإآ]عاق|disab"
# names, signatures, organisations, places
NAME_HEADER = "(?i)اسم|name"
SIGNATURE_HEADER = "(?i)توقيع|signature|imza|\\bsign\\b"
SIGNATURE_GUARD = "(?i)توقيع|imza|signature|sign"
GUARDIAN_HEADER = "(?i)ول[يى]|guardian"
ENTITY_HEADER = "(?i)مؤسس|منظم|شريك|جهة|جهه|مركز|موزع|قاعدي|مدرس|جامع|كلي|company|organization|entity"
PLACE_HEADER = "محافظ|تجمع|سكن|خط\\s*السير|منطقة|بلدة|مخيم|عنوان|address|^من$|^إلى$|^الى$"
PERSON_FIELD = "(?i)اسم|name|المشارك|المستفيد|الموظف|الطالب|رباعي|ثلاثي"
RESCUE_NAME = "(?i)اسم|name|المشارك|المستفيد|الموظف|الطالب"
RESCUE_GUARD = "(?i)ول[يى]|توقيع|guardian|signature"
LEARN_PHONE = "(?i)هاتف|تليفون|جوال|موبايل|phone|mobile|tel|رقم"
# merging two readings of one table
MERGE_PHONE = "(?i)هاتف|جوال|موبايل|تواصل|تلفون|phone|اتصال"
MERGE_DATE = "(?i)تاريخ|ميلاد|ولاد|date|dob"
MERGE_NAME = "(?i)اسم|name|المشارك|المستفيد|رباعي|ثلاثي"
MERGE_NUMBER = "(?i)^#$|رقم.{0,8}تسلسل|عدد|كمية|مبلغ"
# layout
ROW_NUMBER_ONLY = "^[#0-9٠-٩]+$"
ROW_NUMBER_HEADER = "^[#٠-٩0-9\\s]+$"
SERIAL_HEADER = "(?i)^(#[0-9]*|no\\.?|№|م|ت|رقم|الرقم|تسلسل|مسلسل)$"
BLANK_HEADER = "عمود "

# --- fixed values: fixed-choice answers after folding -------------------------------------------------
MALE = ("ذكر", "^(ذكر|ذك|ذكور|زلر|ذار|م|male|m|ولد|صبي)$")
FEMALE = ("أنثى", "^(انثي|انتي|انت|انشي|انش|انني|اني|انه|اثني|التي|ف|female|f|بنت|فتاه|اناث)$")
AGREE = ("موافق", "^(نعم|موافق|ن|yes|y|وافق|قبل|مقبول|مواجهه|موافقه|موافقة|لحم|نهم|لهم|نعنم|بعم)$")
DISAGREE = ("غير موافق", "^(لا|غير موافق|غير\\s*موافق|ل|no|n|رفض|مرفوض|غير)$")
YES = ("نعم", "^(نعم|ايوه|اجل|yes|y|لحم|نهم|لهم|نعنم|بعم)$")
NO = ("لا", "^(لا|كلا|no|n)$")
LONE_MARK = "^[✓✔√×✕✖✗✘xX]$"

# --- fixed values: word lists ---------------------------------------------------------------------------
SUBHEADER_WORDS = ["من", "الي", "from", "to", "start", "end", "بداية", "نهاية", "ذهاب", "اياب"]
COMPOUND_PREFIXES = ["عبد", "أبو", "ابو", "أم", "ام", "بنت", "آل", "ال", "أبي", "ابي"]
NAME_CONNECTORS = ["ابو", "ام", "بنت", "ابن", "بن"]
NAME_PARTICLES = ["أبو", "ابو", "أبي", "ابي", "عبد", "بنت", "بن", "ابن", "آل", "أم", "ام", "الله", "الدين", "الحق",
                  "الرحمن", "دية", "عطا"]
NON_NAME_WORDS = ["اسم", "رقم", "الهاتف", "التاريخ", "العمر", "الجنس", "العنوان", "ملاحظات", "المجموع", "الرقم",
                  "التسلسل", "الفساد", "الباب", "نعم", "لا", "ذكر", "أنثى", "المشروع", "المنظمة", "المستفيد"]
LEARN_NON_NAME = ["اسم", "رقم", "هاتف", "جوال", "تاريخ", "ميلاد", "جنس", "ذكر", "أنثى", "انثى", "نعم", "لا", "موافق",
                  "غير", "العمر", "المشارك", "المستفيد", "الاسم", "رباعي", "ثلاثي", "عنوان", "ملاحظة", "ملاحظات",
                  "مبلغ", "كمية", "عدد", "تسلسل", "المسلسل", "الرقم", "#"]
SPATIAL_NON_NAME = ["ذكر", "أنثى", "انثى", "انه", "أنه", "نعم", "لا", "موافق", "موافقه", "مواقد", "مواقده", "مواجهه",
                    "مصنف", "نث", "-", "–", "—"]
SPATIAL_HEADER_TOKENS = ["الاسم", "رباعي", "مشارك", "للمشارك", "الكامل", "اسم", "#", "رقم", "م", "ت", "الرقم",
                         "التسلسل", "الفئة", "العمرية", "تاريخ", "الميلاد", "النوع", "الاجتماعي", "الإجتماعي",
                         "التواصل", "المحافظة", "التجمع", "السكني", "الموافقة", "التوقيع", "المدارك", "الإعاقة",
                         "إعاقة", "لديك"]
PRIORITY_NAMES = ["محمد", "احمد", "علي", "عمر", "خالد", "يوسف", "عبدالله", "ابراهيم", "اسماعيل", "مصطفى", "مصطفي",
                  "حسن", "حسين", "كريم", "وليد", "سامي", "طارق", "عماد", "رامي", "ايمن", "نادر", "سمير", "جمال",
                  "وائل", "فاطمه", "مريم", "عائشه", "خديجه", "زينب", "سارا", "نور", "ايه", "رنا", "هنا", "سمر", "منى",
                  "ريم", "رشا", "هند", "ليلى", "نادية", "نادي", "سهام", "ولاء", "دعاء", "هبه", "امل", "سلمى", "سلمي",
                  "لما", "روان", "لانا", "سناء", "سنا", "ندى", "لجين"]
BLANK_NAME_WORDS = ["(فارغ)", "فارغ", "-", "", "—", "empty", "blank"]
AGE_WORDS = ["العمر", "السن", "الفئة", "عمره", "عمرها"]

# --- fixed values: line filters of the sequential name reader -----------------------------------------
LINE_SKIP = ("(?i)برنامج|توقيع|اسم الشريك|اسم المؤسسة|التجمع|المحافظة|تاريخ الميلاد|الفئة|إعاقة|هل لديك|استخدام"
             "|الموافقة على|التوثيق|يرجى العلم|مركز البرامج|ساحات|رقم التواصل|الإجتماعي|اجتماعي|النوع الإجتماعي")
LINE_APPROVAL = "(?i)^(موا|فوا|جوا|زلر|مواع|مواجه|مواق)"
LINE_GENDER = "(?iU)\\b(ذكر|انثى|أنثى|WT|CL|آتی|آنر|اول\\s*انه|ذکر|انه)\\b"

# --- fixed values: key synonyms of the key-value reader, in lookup order -------------------------------
KEY_SYNONYMS = [
    ("الاسم", "الاسم"), ("الاسم الكامل", "الاسم"), ("الاسم الرباعي", "الاسم"), ("الاسم الرباعي المشارك", "الاسم"),
    ("اسم المشارك", "الاسم"), ("اسم", "الاسم"), ("name", "الاسم"), ("full name", "الاسم"),
    ("تاريخ الميلاد", "تاريخ الميلاد"), ("تاريخ الولادة", "تاريخ الميلاد"), ("date of birth", "تاريخ الميلاد"),
    ("dob", "تاريخ الميلاد"),
    ("العمر", "العمر"), ("السن", "العمر"), ("الفئة العمرية", "العمر"), ("age", "العمر"), ("age group", "العمر"),
    ("الجنس", "الجنس"), ("gender", "الجنس"), ("sex", "الجنس"),
    ("رقم الهوية", "رقم الهوية"), ("رقم الوطني", "رقم الهوية"), ("رقم البطاقة", "رقم الهوية"),
    ("رقم الجواز", "رقم الهوية"), ("رقم الوثيقة", "رقم الهوية"), ("id", "رقم الهوية"), ("id number", "رقم الهوية"),
    ("رقم الهاتف", "رقم الهاتف"), ("رقم التواصل", "رقم الهاتف"), ("الهاتف", "رقم الهاتف"), ("الجوال", "رقم الهاتف"),
    ("phone", "رقم الهاتف"), ("mobile", "رقم الهاتف"),
    ("الجنسية", "الجنسية"), ("nationality", "الجنسية"),
    ("العنوان", "العنوان"), ("address", "العنوان"), ("المحافظة", "المحافظة"), ("governorate", "المحافظة"),
    ("المهنة", "المهنة"), ("الوظيفة", "المهنة"), ("job", "المهنة"), ("الموافقة", "الموافقة"), ("consent", "الموافقة"),
]

# --- fixed values: cost of reading one character for another ------------------------------------------
CHAR_CONFUSION = {
    ("ا", "أ"): 0.05, ("ا", "إ"): 0.05, ("ا", "آ"): 0.05, ("ا", "ٱ"): 0.05,
    ("أ", "إ"): 0.08, ("أ", "آ"): 0.08, ("إ", "آ"): 0.08,
    ("ب", "ت"): 0.15, ("ب", "ث"): 0.25, ("ت", "ث"): 0.15, ("ب", "ن"): 0.30,
    ("ح", "ج"): 0.10, ("ح", "خ"): 0.10, ("ج", "خ"): 0.10,
    ("ر", "ز"): 0.10, ("د", "ذ"): 0.10, ("س", "ش"): 0.15, ("ص", "ض"): 0.15,
    ("ط", "ظ"): 0.10, ("ع", "غ"): 0.10, ("ف", "ق"): 0.20, ("ه", "ة"): 0.08,
    ("ي", "ى"): 0.05, ("ي", "ئ"): 0.15, ("ى", "ئ"): 0.15, ("و", "ؤ"): 0.08,
    ("ك", "ک"): 0.05, ("ل", "ا"): 0.25, ("ن", "ي"): 0.30, ("م", "ف"): 0.45, ("ق", "ك"): 0.35,
}

# --- fixed values: prices and limits --------------------------------------------------------------------
ROW_PRICE_TENTHS = 15
SIGNUP_GRANT_CENTS = 50
STALE_MINUTES = 20
STALE_MESSAGE = "Processing timed out and was reset by the system. Please reprocess."
ADMIN_BALANCE_LIMIT_CENTS = 100_000
RATE_LIMITS = [
    ("upload_ip", 10, 600), ("upload_user", 5, 60), ("reprocess_ip", 10, 600), ("reprocess_user", 3, 600),
    ("settle_user", 20, 60), ("guest_upload_ip", 3, 3600), ("guest_claim_ip", 20, 600), ("guest_status_ip", 120, 600),
    ("waitlist_ip", 5, 600), ("feedback_ip", 30, 600), ("feedback_user", 10, 600), ("support_ip", 20, 600),
    ("support_user", 5, 600),
]
