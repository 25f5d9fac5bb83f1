"""Bands by script: junk of each class is rejected, prose is kept."""

import random

from tessera.llm import quality

PROSE = {
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם כולם חוננו בתבונה ובמצפון לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה",
    "thai": "มนุษย์ ทั้งหลาย เกิดมา มีอิสระ และ เสมอภาค กัน ในเกียรติศักดิ์ และสิทธิ ต่างมีเหตุผล และมโนธรรม และควรปฏิบัติ ต่อกัน",
    "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है",
    "bengali": "সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে তাঁদের বিবেক এবং বুদ্ধি আছে সুতরাং সকলেরই একে অপরের প্রতি",
    "tamil": "மனிதப் பிறவியினர் சகலரும் சுதந்திரமாகவே பிறக்கின்றனர் அவர்கள் மதிப்பிலும் உரிமைகளிலும் சமமானவர்கள் அவர்கள் நியாயத்தையும் மனச்சாட்சியையும் இயற்பண்பாகப் பெற்றவர்கள்",
    "armenian": "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով Նրանք ունեն բանականություն ու խիղճ և միմյանց պետք է եղբայրաբար վերաբերվեն",
    "georgian": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით მათ მინიჭებული აქვთ გონება და სინდისი",
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах Они наделены разумом и совестью",
    "latin": "All human beings are born free and equal in dignity and rights They are endowed with reason and conscience",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα Είναι προικισμένοι με λογική και συνείδηση",
    "cjk": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다",
    "other": "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው",
}


def junk():
    rnd = random.Random(7)
    words = lambda chars, n=200: " ".join("".join(rnd.choice(chars) for _ in range(rnd.randint(2, 8))) for _ in range(n))
    block = lambda lo, hi, n=200: words([chr(c) for c in range(lo, hi)], n)
    bits = "00000100011001010011101011011111" + "0000"  # every five of them once: no repeated words to the base rules
    out = {"symbols": words("0123456789#$%^&*()!@+=-_"), "short symbols": words("0123456789#$%^&*()!@+=-_", 14), "digits": words("0123456789"), "private": block(0xE000, 0xF900), "emoji": block(0x1F600, 0x1F650)}
    out |= {"short emoji": block(0x1F600, 0x1F650, 12), "arabic": block(0x600, 0x700), "thai": block(0xE01, 0xE2F), "devanagari": block(0x904, 0x93A), "bengali": block(0x980, 0xA00), "tamil": block(0xB80, 0xC00), "armenian": block(0x531, 0x588), "georgian": block(0x10A0, 0x1100)}
    return out | {"two words": " ".join("the" if b == "0" else "of" for b in bits), "two letters": " ".join("אב"[int(b)] for b in bits), "short letters": words("bcdfghjkqvwxz", 14)}


def test_bands_reject_junk_and_keep_prose(spark):
    assert {s: quality.script(t) for s, t in PROSE.items()} == {s: s for s in PROSE} and quality.script("12 !?  \U0001f600") == "none"
    rows = {f"prose {k}": v for k, v in PROSE.items()} | {f"junk {k}": v for k, v in junk().items()}
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(list(rows.items()), "doc_id string, text string")).collect()}
    assert [k for k, r in got.items() if r["base_failed"]] == []
    assert [k for k, r in got.items() if r["kept"] != k.startswith("prose")] == []
