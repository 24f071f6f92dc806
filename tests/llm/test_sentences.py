import pytest

from tidewell.llm.mail import plain_parts
from tidewell.llm.sentences import Lattice, sentence_ends, split_sentences

HEAD = "From: a@b.example\nSubject: x\nMIME-Version: 1.0\n"


def units(text):
    """The units as texts, each from the end of the one before."""
    ends, out, start = sentence_ends(text), [], 0
    for e in ends:
        out.append(text[start:e].split("\n\n")[-1].strip())
        start = e
    return out


def prose(*sentences, sep=" ", end=""):
    text = HEAD + "\n" + sep.join(sentences) + end
    got = sentence_ends(text)
    at, want = len(HEAD) + 1, []
    for s in sentences:
        at += len(s)
        want.append(at)
        at += len(sep)
    return got, want


@pytest.mark.parametrize(
    "sentences",
    [
        ["We moved it.", "Dr. Vourn asked for it, e.g. the one in row 38, by Fri. noon.", "All was done by 5 p.m.", "Why?", "Because it was wet."],
        ["The limit is .2 for the bench (see ch. 41.29.36, pp. 27 ff.) and 3% for the rest.", "it was the crane, imho.", "oKelm? is the odd name of the tool.", "oKelm 9 is the store we chose."],
        ['"It broke. We fixed it." was all the note said.', '"Is it ready?" asked Nadur before the call.', '"The dock is closed."', "(The drum was late again.)", "(The meter was late again.)", "Wait ... the old list is here?!"],
        ["It was sold to Gous Inc.", "Is it really gone?!", "Gous Inc. charges 4.07 per unit vs. 5.29 last year.", "No. 49 on the list is it.", "A. B. Bur and Mrs. Mil share it.", "Turn N. at the valve, then go 29 ft. along the wall to Rm. 48."],
        ['The U.N.-style label says "fragile. do not drop" in red.', "Mail x.example or St. Mil desk, ext. 5, about the job...", "Open log1.Mil.txt or https://Mil.example/q?a=2.1&b=x first.", "Great 🎉 work!!!"],
        ["Am 55. 39. kam er mit Nr. 40 an.", "Den Steg hat die 3. Schicht, vgl. S. 20 f. im Heft.", "Hr. Dr. Houl will ihn bis zum 37. Mai haben, z. B. aus Reihe 13.", "Um 5.30 Uhr kam er (s. o.) dran.", "„Ist er fertig?“, fragte Mil.", "„Er ist zu.“", "Es fehlen A, B usw.", "Der der Brim GmbH & Co. KG kostet 16,65 Taler inkl. Fracht."],
        ["El Sr. Mil y la Dra. Bur piden la bomba, p. ej. la de la fila 26.", "«¿Está lista la tabla?», preguntó Mil.", "¿De verdad se perdió?!", "La de Din S. A. cuesta 676,72 por ud. en EE. UU. y aquí.", "Espera... la tabla sigue aquí.", "¡No puede esperar más!"],
        ["M. Mil et Mme Bur veulent la clé, p. ex. celle du rang 47.", "« Est-ce que la jauge est prête ? » a demandé Mil au quai.", "Qui a pris la table ?", "Il manque la clé, etc.", "La vanne pèse env. 8,5 kg, c.-à-d. moins."],
        ["В 2023 г. купили его за 7,90 тыс. руб. у Din.", "«Где кран?» — спросил Mil утром.", "«Вот список.»", "Вес ок. 4,2 кг, см. рис. 40 и стр. 9.", "Нам нужны кран, склад и т. д.", "А. Б. Bur проверит его.", "Подождите... он ещё здесь?!"],
        ["Πού είναι ο κάδος;", "«Έτοιμος ο κάδος;» ρώτησε ο κ. Mil χθες.", "Βλ. σελ. 11· ο φάκελος άργησε.", "Λείπει ο κάδος κ.λπ.", "Της Jun Α.Ε. κοστίζει 4,7, π.χ. για 5 μέρες."],
        ["طلب د. Mil و أ. Bur المخزن، أي ما في الصف 41.", "من أخذ القائمة؟", "سأل Mil: «هل هي جاهزة؟» ثم أغلق الخط.", "انتظر... القائمة ليست هنا.", "نحتاج المخزن إلخ."],
        ["डॉ. Res को वह चाहिए, जैसे पंक्ति 48 वाली।", '"क्या वह तैयार है?" Mil Bur ने पूछा।', '"रसीद बंद है।"', "पृ. 40 पर चाबी देखिए |", "रुकिए... वह यहाँ नहीं है।"],
    ],
)
def test_spaced_scripts(sentences):
    for sep in (" ", "  ", "\n"):
        got, want = prose(*sentences, sep=sep)
        assert got == want
    got, want = prose(*sentences, end="\n")
    assert got == want


@pytest.mark.parametrize(
    "sentences",
    [
        ["值是4.5。", "他问：“冷库好了吗？”然后挂了电话。", "她喊“停！夜班表！”就走了。", "“旧清单已经关了。”", "（电缆盘又晚了。）", "等一下……冷库不在里面。", "真的丢了吗？！", "见图2等。"],
        ["「止めて！」と言って離れた。", "「荷台は閉まっています。」", "「用意できた？」とMilが聞きました。", "待って…冷蔵庫は夜勤表にありません。", "図2と10.5節の荷台など｡", "（荷台はまた遅れました。）"],
    ],
)
def test_spaceless_scripts(sentences):
    got, want = prose(*sentences, sep="")
    assert got == want
    text = HEAD + "\n" + "".join(sentences)
    cut = text[:-7] + "\n" + text[-7:]  # a line break inside a sentence ends nothing
    assert len(sentence_ends(cut)) == len(sentences)


def test_thai():
    sentences = ["กรุณาส่งเครนเหนือก่อนปิดประตูครับ", "ของเก่าๆ ในตารางน้ำยังอยู่ครบ", "ตรวจเครนเหนือ สมุดปั๊ม ฯลฯ แล้ว", "ค่าเพิ่มจาก 1.5 เป็น 2.5 เมื่อวาน", 'เขาถามว่า "ห้องเย็นพร้อมไหม" แล้ววางสาย', "ใครเอาห้องเย็นไป?", "ดร.Milขอสมุดปั๊มภายในวันศุกร์", "นับได้ 5 กล่องใกล้เครนเหนือ", "เราย้ายเครนเหนือไปข้างวาล์วสำรองแล้ว"]
    for sep in (" ", "\n"):
        got, want = prose(*sentences, sep=sep)
        assert got == want
    assert Lattice(frozenset(["ab", "abc", "cd"])).path("abcd") == ["ab", "cd"]


#: Thai written for this test after the rules, with words other than those of the test corpus; neither lists nor rules were changed to fit it.
OTHER_THAI = [
    ["พนักงานบัญชีส่งใบแจ้งหนี้ให้ลูกค้าแล้ว", "หัวหน้าแผนกอนุมัติงบประมาณเมื่อสัปดาห์ก่อน", "ลูกค้ายังไม่ได้ชำระเงินงวดสุดท้าย"],
    ["แมวของฉันนอนบนเก้าอี้ทั้งวัน", "หมาข้างบ้านชอบเห่าตอนกลางคืน", "เพื่อนบ้านซื้อผลไม้ ขนม และดอกไม้ มาฝากทุกเดือน"],
    ["โรงเรียนเปิดเทอมวันจันทร์หน้า", "นักเรียนทุกคน ต้องสวมเครื่องแบบใหม่", "ครูใหญ่ประกาศกฎใหม่ในห้องประชุม"],
    ["ฝนตกหนักตั้งแต่เช้า", "ถนนหน้าตลาดน้ำท่วมสูง 30 เซนติเมตร และรถติดยาวหลายกิโลเมตร", "ตำรวจแนะนำให้ใช้เส้นทางอื่น"],
    ["หมอสั่งยาแก้ปวดให้คนไข้", "คนไข้ควรดื่มน้ำมากๆ และพักผ่อนให้เพียงพอ", "ถ้าอาการไม่ดีขึ้น ญาติควรพากลับมาพบหมออีกครั้ง"],
    ["บริษัทประกาศผลประกอบการไตรมาสที่สาม เมื่อวานนี้", "กำไรเพิ่มขึ้น 12 เปอร์เซ็นต์ จากปีก่อน", "ผู้ถือหุ้นพอใจกับผลลัพธ์"],
    ["เอกสารที่ส่งมาเมื่อวาน ยังไม่ครบ", "ผมจะโทรหาฝ่ายขายพรุ่งนี้", "สัญญาฉบับใหม่ มีสามหน้า"],
    ["ร้านอาหารริมแม่น้ำปิดปรับปรุง ตั้งแต่เดือนหน้า", "เจ้าของร้านหวังว่า ลูกค้าจะกลับมาอีก", "ราคาอาหารอาจแพงขึ้นเล็กน้อย"],
    ["เด็กๆ วิ่งเล่นในสวนสาธารณะ", "คุณยายนั่งอ่านหนังสือใต้ต้นไม้", "คุณตาตกปลาที่ริมสระ"],
    ["คอมพิวเตอร์ของผมเสียอีกแล้ว", "ช่างบอกว่า ต้องเปลี่ยนจอใหม่", "ค่าซ่อมแพงมาก แต่ผมไม่มีทางเลือก"],
    ["ทีมวิจัยทดลองวัคซีนในหนู 40 ตัว", "ผลการทดลองแสดงว่า วัคซีนปลอดภัย", "นักวิทยาศาสตร์วางแผนทดสอบในคนปีหน้า"],
    ["รถไฟเที่ยวเช้าออกจากสถานีกลาง เวลา 6.30 นาฬิกา", "ผู้โดยสารควรมาถึงก่อนเวลา", "ตั๋วราคา 150 บาท สำหรับผู้ใหญ่"],
]


def test_thai_of_other_vocabulary():
    right = wrong = 0
    for sentences in OTHER_THAI:
        got, want = prose(*sentences)
        right += len(set(got[:-1]) & set(want[:-1]))
        wrong += len(set(got[:-1]) - set(want))
    assert sum(len(x) - 1 for x in OTHER_THAI) == 24
    assert right >= 21 and wrong <= 2  # what was measured; before: 5 and 5


def test_thai_without_end():
    text = HEAD + "\n" + "ตลาด สะพาน " * 20_000  # no verb, no end
    assert sentence_ends(text) == [len(text) - 1]
    text = HEAD + "\n" + "เพื่อนของเราซื้อขนมปังที่ตลาด " * 20_000
    assert len(sentence_ends(text)) == 20_000


#: Notices in wordings and languages that the test corpus does not have; the weights were set with them at hand.
OTHER_NOTICES = [
    "This e-mail and any attachments are confidential and may be privileged. If you are not the intended recipient, please destroy it and notify the sender immediately.",
    "Der Inhalt dieser E-Mail ist vertraulich. Falls Sie nicht der angegebene Empfänger sind, vernichten Sie diese Nachricht bitte umgehend.",
    "Ce courriel peut contenir des informations confidentielles. Toute diffusion est interdite. Si vous n'êtes pas le destinataire, supprimez-le.",
    "Este correo es confidencial. Si usted no es el destinatario, elimínelo. Queda prohibida su difusión.",
    "Questo messaggio è riservato. Se non siete il destinatario, vi preghiamo di distruggerlo. Grazie.",
    "Esta mensagem é confidencial. Se não for o destinatário, apague-a.",
    "Dit bericht is vertrouwelijk. Bent u niet de geadresseerde, verwijder het dan.",
    "Данное сообщение является конфиденциальным. Если вы не получатель, удалите его.",
    "本邮件含有机密信息。如果您不是收件人，请立即销毁。",
    "このメールには機密情報が含まれています。受信者でない場合は破棄してください。",
    "อีเมลนี้เป็นความลับ หากท่านไม่ใช่ผู้รับ โปรดทำลาย",
]
#: Notices that name less, and are known by the rule or sign-off above them.
FOOT_NOTICES = [
    "The contents of this email are confidential. Any unauthorised copying, disclosure or distribution is strictly prohibited.",
    "You receive this because you are subscribed to harbour news. To unsubscribe from the list, write to x@y.example.",
    "Sie erhalten diesen Newsletter, weil Sie ihn abonniert haben. Hier können Sie sich abmelden.",
]


def test_notices_of_other_wording():
    for notice in OTHER_NOTICES:
        text = HEAD + "\nOne is here. Two is not.\n\n" + notice + "\n"
        assert len(sentence_ends(text)) == 3, notice
    for notice in FOOT_NOTICES:
        for above in ("__________", "Kind regards\nMil"):
            assert len(sentence_ends(HEAD + "\n" + above + "\n\n" + notice + "\n")) == 2, notice
    for text, n in (("Please delete the old message. It was sent by mistake.", 2), ("I copied the list for you. The sender was Bob. Call me.", 3), ("The error is gone. I deleted the cache and notified the team.", 2)):
        assert len(sentence_ends(HEAD + "\n" + text)) == n  # prose of the same words


def test_cache_of_blocks_and_words():
    run = "เครนเหนือ"  # opens nothing
    block, paragraph = HEAD + "\n" + run + "\n", HEAD + "\nตรวจห้องเย็น " + run + " แล้ว\n"
    want = {t: sentence_ends(t) for t in (block, paragraph)}
    assert want[block] == [len(block) - 1] and want[paragraph] == [len(paragraph) - 1]
    for order in ((block, paragraph), (paragraph, block)):
        memo = {}
        assert {t: sentence_ends(t, memo) for t in order} == want


def test_blocks_and_quotes():
    text = HEAD + "\n".join(
        ["", "Dear Dr. Mil,", "", "One is here. Two is", "not. ", "> Quoted one. Quoted", "> two!", ">", ">> Deeper. Yes.", "| Bar. Line.", "", "Thanks! ", "Mil Bur", "", "-- ", "Mil Bur", "корп. 20", "____________", "x mailing list", "x@y.example", "", "-----Original Message-----", "From: Mil. Bur", "Sent: 2/10/20 17.50", "", "This message is meant for the addressee only. If it reached you by mistake, delete it.", "", "   "]
    )
    assert units(text)[1:] == [
        "One is here.", "Two is\nnot.", "> Quoted one.", "Quoted\n> two!", ">\n>> Deeper.", "Yes.", "| Bar.", "Line.", "Thanks! \nMil Bur", "-- \nMil Bur\nкорп. 20\n____________\nx mailing list\nx@y.example", "-----Original Message-----\nFrom: Mil. Bur\nSent: 2/10/20 17.50",
        "This message is meant for the addressee only. If it reached you by mistake, delete it.",
    ]


def test_mime_parts():
    inner = 'Content-Type: multipart/alternative;\n boundary="b.alt"\n\n--b.alt\nContent-Type: text/plain; charset=utf-8\n\nInner one. Two.\n--b.alt\nContent-Type: text/html\n\n<p>No. No.</p>\n--b.alt--\n'
    text = HEAD + 'Content-Type: multipart/mixed; boundary="b"\n\nPreamble. None.\n\n--b\n' + inner + "--b\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\nQUJD\n--b\n\nNo type. It counts.\n--b\nContent-Type: message/rfc822\n\nSubject: y\n\nNested. Too.\n--b--\nEpilogue. None."
    got = [text[a:b].strip() for a, b in plain_parts(text)]
    assert got == ["Inner one. Two.", "No type. It counts.", "Nested. Too."]
    assert [u.split("\n")[-1] for u in units(text)] == ["Inner one.", "Two.", "No type.", "It counts.", "Nested.", "Too."]
    open_end = text[: text.index("--b.alt--")] + "rest"
    assert [open_end[a:b].strip() for a, b in plain_parts(open_end)] == ["Inner one. Two."]
    crlf = HEAD.replace("\n", "\r\n") + "\r\nOne.\r\nTwo.\r\n"
    assert [crlf[:e][-4:] for e in sentence_ends(crlf)] == ["One.", "Two."]


def test_edges(spark):
    assert sentence_ends(None) == sentence_ends("") == sentence_ends(" \n ") == sentence_ends(HEAD) == []
    assert sentence_ends("No headers here. Yes.") == [16, 21]
    long = HEAD + "\n" + "A sentence here. " * 50_000
    assert len(sentence_ends(long)) == 50_000
    df = spark.createDataFrame([(1, HEAD + "\nOne. Two.", "clash"), (1, HEAD + "\nOne. Two.", ""), (2, None, ""), (None, "Xa. Yb.", "")], "doc_id bigint, text string, end_char string")
    got = sorted((r.doc_id is not None, r.doc_id, r.end_char) for r in split_sentences(df).collect())
    n = len(HEAD)
    assert got == [(False, None, 3), (False, None, 7), (True, 1, n + 5), (True, 1, n + 5), (True, 1, n + 10), (True, 1, n + 10)]
    assert split_sentences(df.limit(0)).count() == 0


def test_titles():
    for sentences in (
        ["We asked Gov. Smith and Sen. Adams about it.", "Capt. Jones and Sgt. Pepper had left."],
        ["Das Buch von Hrsg. Müller liegt hier.", "Dipl. Ing. Weber hat es."],
        ["The note is by Brgdr. Kane and Msgr. Lowe.", "Both were late."],  # one of them is in no list
    ):
        got, want = prose(*sentences)
        assert got == want


#: Lao written for this test; the lists were not changed to fit it.
LAO = [
    ["ຂ້ອຍໄປຕະຫຼາດມື້ນີ້", "ພວກເຮົາຊື້ເຂົ້າແລະປາ"],
    ["ລາວອ່ານປຶ້ມຢູ່ເຮືອນ", "ກະລຸນາສົ່ງຈົດໝາຍໃຫ້ຂ້ອຍ"],
    ["ຂ້ອຍເຫັນຊ້າງ ມ້າ ແລະ ງົວ"],
    ["ເຮົາຮຽນພາສາລາວ", "ທ່ານເວົ້າຫຍັງ"],
]


def test_lao():
    right = wrong = 0
    for sentences in LAO:
        got, want = prose(*sentences)
        right += len(set(got[:-1]) & set(want[:-1]))
        wrong += len(set(got[:-1]) - set(want))
    assert right == 3 and wrong == 0


def test_marks_of_other_scripts():
    for sentences in (["សួស្តី។", "ខ្ញុំសុខសប្បាយ។"], ["ကျွန်တော် သွားမယ်။", "နေကောင်းလား။"], ["བཀྲ་ཤིས།", "བདེ་ལེགས།"]):
        got, want = prose(*sentences)
        assert got == want


def test_words_are_never_cut_at_a_window():
    long = "Sehr" * 20
    got, want = prose(f"{long}.de ist der Ort.", f"Am 12. {long}. 3 kam es.", "Ende.")
    assert want[0] in got and want[-1] in got
    # a sign-off of many lines, and an address far above the colon
    assert len(sentence_ends(HEAD + "\nKind regards\nMil. Bur\nDept. Two\nHall. Nine\nx@y.example\n")) == 1
    assert len(sentence_ends(HEAD + "\nOn Fri. 3 Jan. 2020\nMil Bur\n<x@y.example>\nin the list\nwrote:\n")) == 1
    assert len(sentence_ends(HEAD + "\nPlease write to all of us at x@y.example today. The list is:\n")) == 2


def test_unit_needs_a_word():
    got = sentence_ends(HEAD + "\nIt is done. ... ! Yes it is.")
    assert all(any(c.isalnum() for c in t) for t in units(HEAD + "\nIt is done. ... ! Yes it is.")) and len(got) == 2


def test_notices_as_prose():
    text = HEAD + "\nThis message is meant for the addressee only. If it reached you by mistake, delete it."
    assert len(sentence_ends(text)) == 1 and len(sentence_ends(text, notices=False)) == 2


def test_long_texts_take_linear_time():
    import time

    for piece in ("1. 2. ", "a.b.", "() ", "ok... ", "“a.” ", "เพราะ ", "x@y: "):
        text = HEAD + "\n" + piece * (60_000 // len(piece))
        began = time.perf_counter()
        sentence_ends(text)
        assert time.perf_counter() - began < 20, piece


def test_dictionary_tries():
    from tidewell.llm import dictionaries

    trie = dictionaries.Trie(dictionaries.load("thai"))
    assert "การ" in {"การทำงาน"[:e] for e in trie.ends("การทำงาน", 0)} and trie.ends("abc", 0) == [] and trie.ends("", 0) == []
    with pytest.raises(FileNotFoundError):
        dictionaries.load("thai", "/nowhere")
