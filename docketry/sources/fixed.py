"""Word lists, tables, bounds and patterns that results depend on.

Everything here is data, never logic; each operator takes these as defaults and
accepts replacements. Larger tables (concept signals, regulation corpora) are
files named by the caller, see ``loaders``.
"""

# --- intake -----------------------------------------------------------------
MIN_TEXT_CHARACTERS = 40
MAX_TEXT_CHARACTERS = 20_000
FALLBACK_LANGUAGE = "tr"
MARKER_MARGIN = 1.25
LANGUAGE_MARKERS = {
    "tr": (
        "ve", "bir", "bu", "için", "ile", "olarak", "olan", "üzere", "tarafından",
        "gereğini", "arz", "ederim", "talep", "ediyorum", "değil", "daha", "sayın",
        "ilgili", "konu", "ancak", "veya", "şekilde", "kadar", "sonra", "önce",
        "adresinde", "tarihinde", "hakkında", "nedeniyle", "bulunan", "yapılan",
    ),
    "en": (
        "the", "and", "of", "to", "is", "are", "for", "with", "this", "that",
        "have", "has", "been", "would", "please", "regarding", "your", "our",
        "from", "which", "not", "was", "will", "there", "their", "at", "on",
        "in", "by", "as", "an", "be", "kindly", "request",
    ),
}
TURKISH_LETTERS = "çğışöüÇĞİŞÖÜ"
TOKEN_CHARACTERS = "0-9A-Za-zÀ-ÿĞğİıŞşÇçÖöÜü"
SALUTATION_PATTERN = r"(?i)(başkanlığına|makamına|müdürlüğüne|başkanlığı'na)\s*,?\s*$"
DEFAULT_TITLE = "Vatandaş dilekçesi"

# --- classification ---------------------------------------------------------
CLASSIFIED_ABOVE = 0.80
REQUIRED_SIGNALS = 3
MIN_PREFIX_LENGTH = 4
EXACT_TOKEN_MARKER = "$"
DEFAULT_KEYWORD_LANGUAGE = "tr"
KEYWORD_CLASSIFIER_VERSION = "demo-keyword-v2"
SIGNAL_CLASSIFIER_VERSION = "demo-semantic-v3"
TAXONOMY_VERSION = "demo-belediyesi-v2"

DEPARTMENTS = (
    ("vatandas-hizmetleri", "Vatandaş Hizmetleri Müdürlüğü"),
    ("bilgi-islem", "Bilgi İşlem Müdürlüğü"),
    ("mali-hizmetler", "Mali Hizmetler Müdürlüğü"),
    ("imar-sehircilik", "İmar ve Şehircilik Müdürlüğü"),
    ("zabita", "Zabıta Müdürlüğü"),
    ("diger", "Diğer / Sınıflandırılamayan Başvurular Müdürlüğü"),
)
UNITS = (
    ("beyaz-masa", "Beyaz Masa Birimi", "vatandas-hizmetleri"),
    ("dijital-hizmetler", "Dijital Hizmetler Birimi", "bilgi-islem"),
    ("gelir-tahakkuk", "Gelir ve Tahakkuk Birimi", "mali-hizmetler"),
    ("ruhsat", "Ruhsat Birimi", "imar-sehircilik"),
    ("denetim", "Denetim Birimi", "zabita"),
    ("siniflandirilmamis", "Diğer / Sınıflandırılamayan Başvurular Birimi", "diger"),
)
REQUEST_TYPES = (
    # id, label, unit, Turkish keywords, English keywords
    ("adres-bildirimi", "Adres Değişikliği Bildirimi", "beyaz-masa",
     ("adres", "değişiklik", "ikamet", "bildirim", "kayıt"), ("address", "change", "residen", "notif", "record")),
    ("bilgi-edinme", "Bilgi Edinme Talebi", "beyaz-masa",
     ("bilgi", "talep", "faaliyet", "rapor", "edinme"), ("information", "request", "activit", "report", "access")),
    ("e-imza-arizasi", "E-İmza Arızası", "dijital-hizmetler",
     ("e-imza", "sertifika", "imzalama", "hata", "sistem"), ("signature", "certificat", "digital", "error", "system")),
    ("sistem-erisim-arizasi", "Sistem Erişim Arızası", "dijital-hizmetler",
     ("sistem", "erişim", "giriş", "şifre", "arıza"), ("system", "access", "password", "unable", "account")),
    ("fatura-islemi", "Fatura İşlemi", "gelir-tahakkuk",
     ("fatura", "ödeme", "tahakkuk", "mal", "hizmet"), ("invoice", "payment", "amount", "service", "goods")),
    ("odeme-itirazi", "Ödeme İtirazı", "gelir-tahakkuk",
     ("ödeme", "itiraz", "borç", "tahsilat", "vergi"), ("payment", "object", "debt", "collect", "tax")),
    ("ruhsat-basvurusu", "Ruhsat Başvurusu", "ruhsat",
     ("ruhsat", "başvuru", "işyeri", "izin", "belge"), ("licen", "applicat", "business", "permit", "document")),
    ("ruhsat-sorgusu", "Ruhsat Durum Sorgusu", "ruhsat",
     ("ruhsat", "durum", "sorgu", "başvuru", "sonuç"), ("licen", "status", "inquir", "applicat", "result")),
    ("gurultu-sikayeti", "Gürültü Şikayeti", "denetim",
     ("gürültü", "gece", "desibel", "rahatsızlık", "şikayet"), ("noise", "disturb", "quiet", "inspect", "residen")),
    ("isyeri-denetimi", "İşyeri Denetim Bildirimi", "denetim",
     ("işyeri", "denetim", "rapor", "tutanak", "kontrol"), ("business", "inspect", "report", "record", "control")),
)

# --- rule baseline ----------------------------------------------------------
DOCUMENT_TYPE_RULES = (
    ("dilekçe", "temel", ("talep", "başvuru", "istemek", "gereğini arz ederim", "lütfen", "imkan", "destek", "yardım", "değişiklik", "belgesini gönder", "yapılmasını talep")),
    ("şikayet", "kapsamli", ("şikayet", "problem", "sorun", "hata", "yanlış", "uygunsuz", "tehlike", "eksik", "arıza", "ince", "denetim", "inceleme", "rahatsız", "mağdur", "zararıma")),
    ("bilgi_talebi", "minimal", ("bilgi", "öğrenme", "sorgulama", "koşul", "prosedür", "nasıl", "ne zaman", "nerede", "kaç", "hangi", "durum", "haber", "ayrıntı", "durumum", "açıklamasını istiyorum")),
    ("başvuru_formu", "kapsamli", ("başvuru", "başvurmak", "katılım", "kaydolma", "kayıt", "başvurmakla", "değerlendirmesi", "programa katılma")),
    ("itiraz", "kapsamli", ("itiraz", "haksız", "yanlış", "yeniden inceleme", "iptali", "kaldırması", "düzeltilmesi", "iptal", "karşı çıkıyorum", "karşılaştırması")),
)
SALUTATION_BONUS = ("dilekçe", "sayın", 0.1)          # type, opening word, bonus
OPENING_BONUS = (("şikayet", 0.15), ("itiraz", 0.15))  # type word in the first 50 characters
OPENING_CHARACTERS = 50
DEPARTMENT_RULES = (
    ("Fen İşleri Müdürlüğü", ("yol", "kaldırım", "sokak", "köprü", "asfalt", "çukur", "pothole", "altyapı", "kanalizasyon", "elektrik hattı", "ağaç", "temizlik", "fen", "bakım onarım")),
    ("İmar ve Şehircilik Müdürlüğü", ("imar", "ruhsat", "yapı", "taş", "parsel", "ada", "kaçak yapı", "yıkım", "inşaat", "bina", "konut")),
    ("Mali Hizmetler Müdürlüğü", ("vergi", "fatura", "borç", "su", "elektrik", "doğalgaz", "gaz", "mali", "makbuz", "ödeme", "kesinti", "ceza")),
    ("İnsan Kaynakları Müdürlüğü", ("personel", "maaş", "izin", "başvuru", "sicil", "görev", "çalışan", "istihdam", "emekli", "yer değişikliği", "bordro")),
    ("Sosyal Hizmetler Müdürlüğü", ("sosyal yardım", "yaşlı", "engelli", "zor durum", "yardım", "bakıcı", "bakım", "destek", "muhtaç", "ihtiyaçlı")),
    ("Sağlık Hizmetleri Müdürlüğü", ("hastane", "sağlık", "aşı", "tıbbi", "doktor", "randevu", "tedavi", "sağlık hizmeti")),
    ("Zabıta Müdürlüğü", ("gürültü", "trafik", "emniyet", "kabahat", "ceza", "tutanak", "güvenlik", "polis", "şikayet", "düzen")),
    ("Eğitim Müdürlüğü", ("okul", "öğrenci", "not", "eğitim", "öğretmen", "sınav", "burs", "sınıf", "akademik", "derece")),
    ("Çevre Müdürlüğü", ("çevre", "kirliliği", "atık", "duman", "koku", "kirli", "zehirli", "hava", "ağaç", "yeşil")),
    ("Kültür ve Turizm Müdürlüğü", ("kültür", "sergi", "kütüphane", "kitap", "sanat", "etkinlik", "turizm", "turist", "tarihî")),
    ("Tarım Müdürlüğü", ("tarım", "hayvan", "ürün", "çiftçi", "arazi", "mahsul", "zirai", "destekmiş", "tarımsal")),
)
DEFAULT_DEPARTMENT = "Genel Sekreterlik"
REQUIRED_FIELD_TABLE = {
    "dilekçe_temel": ("Ad Soyad", "Adres", "Telefon"),
    "şikayet_kapsamli": ("Ad Soyad", "Adres", "Telefon", "Şikayet Konusu"),
    "başvuru_formu_kapsamli": ("Ad Soyad", "TC Kimlik No", "Adres", "Telefon", "E-posta", "İlişkili Belgeler"),
    "itiraz_kapsamli": ("Ad Soyad", "Karar/Tutanak No", "Tebliğ Tarihi", "İtiraz Gerekçesi", "İspat Belgeleri"),
    "bilgi_talebi_minimal": ("Ad Soyad", "TC Kimlik No", "Telefon"),
}
FIELD_PATTERNS = {
    "Ad Soyad": r"(?im)(?:ad[ıi]m?|ad soyad)\s*[:\-]?\s*[A-ZÇĞİÖŞÜ][a-zçğıöşü]+\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü]+",
    "TC Kimlik No": r"\b\d{11}\b",
    "Telefon": r"\b0\d{3}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}\b",
    "E-posta": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "Adres": r"(?i)\b(mahalle|mah\.?|sokak|sk\.?|cadde|cd\.?|köy|adres)\b",
    "Karar/Tutanak No": r"(?i)\b(karar|tutanak)\s*(no)?\s*[:\-]?\s*\w+",
    "Tebliğ Tarihi": r"\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b",
    "İtiraz Gerekçesi": r"(?i)\b(gerekçe|haksız|yanlış|itiraz)\b",
    "İspat Belgeleri": r"(?i)\b(ek|belge|kanıt|ispat)\b",
    "İlişkili Belgeler": r"(?i)\b(ek|belge|dosya)\b",
    "Şikayet Konusu": r"(?i)\b(şikayet|sorun|problem|uygunsuz|arıza)\b",
}
LEGISLATION = (
    ("sosyal yardım", ("5434 Sayılı Sosyal Yardımlaşma ve Dayanışmayı Teşvik Kanunu", "Ailenin Korunması ve Çocuk Hakları Kanunu")),
    ("engelli", ("Engelliler Kanunu", "Engelli ve Yaşlı Bakım Kurumları Yönetmeliği")),
    ("istihdam", ("İş Kanunu", "Memurlar Kanunu")),
    ("eğitim", ("Milli Eğitim Kanunu", "Öğretmen Devlet Memurluğu Kanunu")),
    ("sağlık", ("Sağlık Hizmetleri Sunumu Yönetmeliği", "Hasta Hakları Yönetmeliği")),
    ("çevre", ("Çevre Kanunu", "Hava Kirliliği Kontrol Yönetmeliği")),
    ("trafik", ("Kabahatler Kanunu", "Karayolları Trafik Yönetmeliği")),
    ("vergi", ("Vergi Usul Kanunu", "Mali İşler Yönetmeliği")),
    ("imar", ("Yapı Denetim Sistemi Kanunu", "Tapu Kanunu")),
)
DEFAULT_LEGISLATION = "Genel Kamu Yönetimi Kanunu"
LETTER_TYPES = (
    ("dilekçe", "İnsan Kaynakları Müdürlüğü", ("Başvuru Sonuç Yazısı", "Başvuru Kabul Yazısı")),
    ("şikayet", "Zabıta Müdürlüğü", ("Soruşturma Başlatma Yazısı", "Müfettiş Görevlendir Yazısı")),
    ("bilgi_talebi", "*", ("Bilgi Yanıt Yazısı", "Bilgilendirme Metni")),
    ("başvuru_formu", "Sosyal Hizmetler Müdürlüğü", ("Başvuru Kabul Yazısı", "Başvuru Red Yazısı")),
    ("itiraz", "*", ("İtiraz Sonuç Yazısı", "Yeniden İnceleme Yazısı")),
)
DEFAULT_LETTER_TYPE = "Resmi Yazı"

# --- priority and behaviour -------------------------------------------------
PRIORITY_RULES = (
    ("critical", 100, "yangin", "Yangın riski"),
    ("critical", 100, "gaz kacagi", "Gaz kaçağı riski"),
    ("critical", 100, "patlama", "Patlama riski"),
    ("critical", 100, "cokme", "Çökme riski"),
    ("critical", 100, "can guvenligi", "Can güvenliği riski"),
    ("critical", 100, "yarali", "Yaralı bildirimi"),
    ("critical", 100, "acil mudahale", "Acil müdahale talebi"),
    ("high", 70, "su baskini", "Su baskını"),
    ("high", 70, "kanalizasyon", "Kanalizasyon etkisi"),
    ("high", 70, "zehirlenme", "Zehirlenme riski"),
    ("high", 70, "hijyen", "Hijyen riski"),
    ("high", 70, "salgin", "Salgın riski"),
)
DEFAULT_PRIORITY = ("normal", 40, "Öncelik sinyali bulunmadı")
BEHAVIOR_MARKERS = (
    ("tehdit", 1.0), ("öldür", 1.0), ("şiddet", .9), ("rezalet", .45),
    ("süründür", .7), ("terbiyesiz", .55), ("hırsız", .55), ("yolsuz", .55),
    ("ulan", .35), ("lan", .3), ("bıktım", .35), ("sıkıldım", .35), ("beceriksiz", .6),
    ("dava açarım", .4), ("savcılığa vereceğim", .4),
)
BEHAVIOR_MARKERS_EN = (
    ("threat", 1.0), ("kill", 1.0), ("violence", .9), ("unacceptable", .45),
    ("disgrace", .45), ("corrupt", .55), ("lawsuit", .4), ("prosecut", .4),
    ("you will pay", .7),
)
HIGH_BEHAVIOR = 0.7
REPEAT_TRIGGER = 3

# --- fields -----------------------------------------------------------------
FIELD_SCHEMA_VERSION = "demo-belediyesi-fields-v1"
FIELD_KINDS = ("free-text", "tckn", "phone-tr", "date", "document-number", "money-try", "attachment")
MAX_FIELDS_PER_TYPE = 8
REGISTRY_TYPES = 10
MAX_FREE_TEXT = 4096
_NAME = ("applicant-name", "Başvuru sahibi", "free-text", True)
_TCKN = ("tckn", "T.C. Kimlik Numarası", "tckn", True)
_PHONE = ("phone", "Telefon", "phone-tr", False)
FIELD_REGISTRY = {
    "adres-bildirimi": (_NAME, _TCKN, ("new-address", "Yeni adres", "free-text", True), _PHONE),
    "bilgi-edinme": (_NAME, _TCKN, ("request-subject", "Talep konusu", "free-text", True), _PHONE),
    "e-imza-arizasi": (_NAME, _TCKN, ("problem-description", "Sorun açıklaması", "free-text", True), _PHONE),
    "sistem-erisim-arizasi": (_NAME, _TCKN, ("problem-description", "Sorun açıklaması", "free-text", True), _PHONE),
    "fatura-islemi": (
        ("supplier-name", "Tedarikçi adı", "free-text", True),
        ("invoice-number", "Fatura numarası", "document-number", True),
        ("invoice-date", "Fatura tarihi", "date", True),
        ("invoice-amount", "Fatura tutarı", "money-try", True),
        ("invoice-attachment", "Fatura eki", "attachment", True),
        _PHONE,
    ),
    "odeme-itirazi": (_NAME, _TCKN, ("payment-reference", "Ödeme referansı", "document-number", True),
                      ("objection-reason", "İtiraz gerekçesi", "free-text", True), _PHONE),
    "ruhsat-basvurusu": (_NAME, _TCKN, ("business-address", "İşyeri adresi", "free-text", True),
                         ("business-activity", "Faaliyet konusu", "free-text", True),
                         ("application-attachment", "Başvuru eki", "attachment", False)),
    "ruhsat-sorgusu": (_NAME, _TCKN, ("application-number", "Başvuru numarası", "document-number", True), _PHONE),
    "gurultu-sikayeti": (_NAME, _TCKN, ("incident-address", "Olay adresi", "free-text", True),
                         ("incident-date", "Olay tarihi", "date", True),
                         ("incident-description", "Olay açıklaması", "free-text", True), _PHONE),
    "isyeri-denetimi": (("business-name", "İşyeri adı", "free-text", True),
                        ("business-address", "İşyeri adresi", "free-text", True),
                        ("inspection-subject", "Denetim konusu", "free-text", True),
                        ("document-number", "Belge numarası", "document-number", False)),
}
RULE_FIELD_PATTERNS = (
    # field, pattern, capture group
    ("tckn", r"(?<!\d)(\d{11})(?!\d)", 1),
    ("phone", r"(?<!\d)(?:\+90|0)?5\d{9}(?!\d)", 0),
    ("incident-date", r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4})(?!\d)", 0),
    ("invoice-date", r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4})(?!\d)", 0),
)
RULE_CONFIDENCE, LABEL_CONFIDENCE, ANSWER_CONFIDENCE = 1.0, 0.8, 0.5
ANSWER_EXCLUDED_KINDS = ("tckn", "phone-tr", "date", "attachment")
APPLICANT_NAME_KEYS = ("applicant-name", "business-name", "supplier-name")

# --- retrieval --------------------------------------------------------------
STOPWORDS = ("ve", "veya", "ile", "için", "bir", "bu", "şu", "da", "de", "mi", "mı", "mu", "mü", "olan", "olarak",
             "sayılı", "kanun", "kanunu", "madde", "maddesi", "kapsamında")
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60
TOP_K = 5
MIN_SIMILARITY = 0.60
MAX_QUERY_CHARACTERS = 1200
MAX_EXCERPT_CHARACTERS = 500
CITATION_KEYS = ("source_id", "corpus_version", "title", "source_type", "locator", "chunk_id",
                 "official_source_url", "excerpt", "score")
RELABEL_TARGETS = {
    "document_summary": "başvuru belgesi kısa özet summary",
    "recommended_correspondence_type": "resmi yazışma türü correspondence type",
    "draft_text": "resmi yazışma taslak metni draft letter",
    "used_source_refs": "kullanılan kaynak atıf kimlikleri citation references",
}
CORRESPONDENCE_DESCRIPTIONS = {
    "response_letter": "cevap yazısı response letter",
    "information_letter": "bilgilendirme yazısı information letter",
    "referral_letter": "yönlendirme sevk yazısı referral letter",
    "cover_letter": "üst yazı cover letter",
    "other": "diğer resmi yazışma other correspondence",
}

# --- personal data ----------------------------------------------------------
FIELD_HANDLING = {
    "applicant-name": "redact", "supplier-name": "redact", "tckn": "redact", "phone": "redact",
    "new-address": "redact", "business-address": "redact", "incident-address": "task_required",
    "incident-description": "task_required", "incident-date": "task_required", "business-activity": "task_required",
    "problem-description": "task_required", "request-subject": "task_required", "inspection-subject": "task_required",
    "objection-reason": "task_required", "payment-reference": "exclude", "invoice-number": "exclude",
    "invoice-date": "task_required", "invoice-amount": "task_required", "application-number": "exclude",
    "document-number": "exclude",
}
PLACEHOLDER_ALIASES = {
    "applicant-name": "APPLICANT_NAME", "supplier-name": "SUPPLIER_NAME", "tckn": "APPLICANT_TCKN",
    "phone": "PHONE", "applicant-address": "APPLICANT_ADDRESS",
}
RESIDUAL_PATTERNS = (
    ("TCKN", r"(?<!\d)[1-9]\d{10}(?!\d)"),
    ("PHONE", r"(?<!\d)(?:\+90|0)?5\d{9}(?!\d)"),
    ("EMAIL", r"(?iu)(?<![\p{L}\p{N}_])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\p{L}\p{N}_])"),
    ("IBAN", r"(?iu)(?<![\p{L}\p{N}_])TR\d{2}(?:\s?\d{4}){5}\s?\d{2}(?![\p{L}\p{N}_])"),
)
MAX_LEARNING_CHARACTERS = 12_000

# --- drafts and letters -----------------------------------------------------
MAX_SUMMARY, MAX_DRAFT, MAX_TYPE_DETAIL, MAX_CITATIONS = 600, 6000, 200, 5
CORRESPONDENCE_TYPES = ("response_letter", "information_letter", "referral_letter", "cover_letter", "other")
DRAFT_REQUIRED = ("document_summary", "recommended_correspondence_type", "draft_text", "used_source_refs")
DRAFT_OPTIONAL = ("correspondence_type_detail",)
LEGAL_CLAIM_PATTERNS = (
    r"(?iuU)\b\d{3,6}\s+sayılı\b",
    r"(?iuU)\bmadde\s+\d+\b",
    r"(?iuU)\b\d+\.\s*madde(?:si|sine|sinde|ye)?\b",
    r"(?iuU)(?:kanun\w*|yasa\w*|yönetmelik\w*|mevzuat\w*|tebliğ\w*|genelge\w*|madde\w*)(?:\s+\S+){0,4}\s+"
    r"(?:uyarınca|gereğince|göre|kapsamında|hükmü|uygun\s+olarak)",
    r"(?iuU)\b(?:zorunludur|yasaktır|kanunen mümkündür|yasal yükümlülüktür)\b|kurum\s+.+?\s+yükümlüdür",
)
CHUNK_CHARACTERS = 900
DEFAULT_REFERENCE = "İlgili mevzuat ve kurum içi prosedürler doğrultusunda işlem yapılacaktır."
DEFAULT_ROUTE_NAME = "Yetkili Birim"
LETTER_OPENING = "Sayın %s,\n\n"
LETTER_CLOSING = "\n\nSaygılarımla,"
LETTER_BODIES = {
    # %1$s subject, %2$s missing items or document excerpt
    "eksik_bilgi_talebi": "%1$s konulu başvuruda işlem için eksik bilgi bulunmaktadır. Aşağıdaki hususların gönderilmesi gerekmektedir: %2$s.\n\nİlave bilgi iletilmesi halinde işleme devam edilecektir.",
    "yönlendirme": "%1$s konulu dosya, ilgili iş akışı kapsamında tarafınıza yönlendirilmiştir. İşlem ve gerekli takip için ilgili birim tarafından değerlendirme yapılacaktır.",
    "bilgilendirme": "%1$s konusu kapsamında bilgilendirme yapılmıştır. Belge içeriğinde yer alan hususların dikkate alınması ve gerekli işlemlerin yürütülmesi önem arz etmektedir.",
    "üst_yazı": "%1$s konusu ilişiğinde tarafımıza ulaştırılan evrak değerlendirilmiş olup, ilgili kurum/kuruluş bilgileri dikkate alınarak üst yazı kapsamında gerekli işlemler yapılacaktır.",
    "cevap": "%1$s konusundaki talep/başvurunuz incelenmiş olup, aşağıdaki şekilde cevap verilmiştir.\n\n%2$s\n\nGerekli işlemler çerçevesinde tarafınıza dönüş sağlanacaktır.",
}
NOTICE_TITLES = {"applicant": "Başvurunuz işleme alındı", "target_unit": "Yeni başvuru yönlendirildi"}
NOTICE_CONTEXT_KEYS = ("request_type_id", "validated_fields", "document_summary", "draft_text", "regulation_suggestions")
MAX_NOTICE_TITLE, MAX_NOTICE_BODY = 200, 4000

# --- routing, states and queue ----------------------------------------------
FALLBACK_DEPARTMENT, FALLBACK_UNIT = "diger", "siniflandirilmamis"
MAX_START_ATTEMPTS = 4
RETRY_COOLDOWN_SECONDS = 30
STAFF_CANDIDATES = 25  # what an interactive screen passes as ``candidates``
STAFF_UNITS = (
    ("beyaz-masa", "Beyaz Masa"), ("dijital-hizmetler", "Dijital Hizmetler"),
    ("gelir-tahakkuk", "Gelir ve Tahakkuk"), ("ruhsat", "Ruhsat"), ("denetim", "Denetim"),
    ("siniflandirilmamis", "Genel Başvuru"),
)
RELATED_POOL, RELATED_THRESHOLD, RELATED_LIMIT = 200, 20, 5  # the pool is what an interactive screen passes
PAGE_DEFAULT, PAGE_MAX = 25, 100
QUEUE_TABS = (
    ("", "Tümü"), ("needs_review", "İnsan incelemesi"), ("waiting_for_user", "Ek bilgi bekleniyor"),
    ("ready_for_processing", "Taslak hazırlanıyor"), ("draft_prepared", "Taslak hazır"), ("completed", "Tamamlandı"),
)
CHANNEL_LABELS = {"citizen-portal": "Dilekçe ekranı", "operator-console": "Operatör"}
LANGUAGE_LABELS = {"tr": "Türkçe", "en": "İngilizce", "unknown": "Belirlenemedi"}
