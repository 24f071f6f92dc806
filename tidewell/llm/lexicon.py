"""Fixed values of the sentence splitter: short word lists, by language."""

from dataclasses import dataclass, fields

# --- fixed values -----------------------------------------------------------------------------------------------------
#: Abbreviations that never end a sentence: titles, and words that need what follows.
NEVER_LAST = frozenset(
    "Capt Col Cmdr Cpl Lt Maj Sgt Adm Gov Sen Rep Pres Supt Msgr Mx Insp Det Amb Hrsg Bearb Ing Dipl Mag Pfr Gfr Abg Min Frhr Univ Lic Arq Dña Gral Cnel Excmo Ilmo Mgr Mlles MM Me Pr Avv Dott Sig Sigg Egr Spett Geom Mevr Dhr проф акад "
    "Dr Mr Mrs Ms Prof St Hon Rev Gen Sr Sra Srta Dra Hr Hrn Fr Frl Mme Mlle Mgr Messrs e.g i.e approx vs cf viz al "
    "Tel tel Fax fax Mob mob z d h s o u v a i vgl ca bzw inkl exkl zzgl evtl ggf sog geb Str EE ex ej env c.-à-d p.ex p.ej "
    "т е см ок тыс млн млрд ул корп им г-н г-жа π.χ δηλ Βλ βλ κ κα αρ д. أ د डॉ श्री श्रीमती सं कृ".split()
)
#: Abbreviations before a number or a name; an upper-case word after them begins a sentence.
BEFORE_NUMBER = frozenset(
    "No Nos Nr fig Fig ch Ch p pp ext Rm sec Sec art vol Vol Abb Abs S Kap Bd Tab pág págs cap núm n рис стр гл ст табл п № σελ σσ κεφ पृ ref eq".split()
)
#: Abbreviations that can end a sentence: what follows decides.
MAY_BE_LAST = frozenset(
    "Inc Ltd Co Corp Bros KG AG etc usw usf imho a.m p.m am pm ft in lb oz min hr hrs f ff ud uds UU Cía г гг руб коп д др к.λπ κ.λπ κ.ά κτλ "
    "Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split()
)
#: Before a German ordinal.
ORDINAL_AFTER = frozenset(
    "am zum vom der die das den dem des im bis beim ab seit jeder jede jedes Am Zum Vom Der Die Das Den Dem Im Bis Beim Ab Seit".split()
)
#: Words that begin a sentence in lower case.
LOWER_OPENERS = frozenset("it".split())
#: Sign-offs, without marks at their end.
SIGN_OFFS = frozenset(
    s.casefold()
    for s in (
        "Regards", "Best", "Best regards", "Kind regards", "Thanks", "Many thanks", "Thank you", "Cheers", "Sincerely", "Yours", "MfG", "Viele Grüße", "Beste Grüße", "Liebe Grüße", "Grüße", "Danke", "Cordialement", "À bientôt", "Merci", "Bien à vous",
        "Un saludo", "Saludos", "Gracias", "С уважением", "Спасибо", "Ευχαριστώ", "Με εκτίμηση", "مع التحية", "شكرا", "धन्यवाद", "सादर", "谢谢", "此致", "敬上", "よろしくお願いします", "よろしくお願いいたします", "ขอบคุณครับ", "ขอบคุณค่ะ", "ขอบคุณ",
    )
)
#: What notices below messages speak of (disclaimers, list footers), with its weight: stems at the beginning of a word, case-folded.
NOTICE_STEMS = {
    "message": (1, "message mail e-mail email nachricht mensaje correo mensagem messaggio courriel bericht wiadomoś сообщени письмо лист μήνυμα"),
    "sender": (1, "sender absender remitente remetente mittente expéditeur afzender nadawc отправител αποστολέ notify informieren avise prévenez avvisare уведом"),
    "recipient": (2, "addressee recipient intended empfänger adressat gerichtet destinatari destinatário destinataire destiné geadresseerde ontvanger adresat odbiorc адресат получател παραλήπτ"),
    "error": (2, "mistake error erroneous irrtümlich versehentlich irrtum fehlgeleitet equivocación engano erro errore erreur abusivement vergissing onbedoeld pomyłk ошиб λάθος"),
    "delete": (2, "delete destroy erase lösch vernicht borre borr bórr elimin destruy destru apagu apague cancell distrugg effac supprim détrui verwijder vernietig usun удал уничтож διαγρά καταστρ"),
    "secret": (2, "confidential privileg proprietary vertraulich geheim confidencial reservad riservat confidentiel vertrouwelijk poufn конфиденциальн εμπιστευτικ"),
    "spread": (2, "disclos disseminat distribut unauthori unauthoriz copying copy weitergabe weiterleit unbefugt vervielfält divulg difund difusión prohibid diffus interdit autoris divulgaz diffond vietat verspreid verboden распростран запрещ копирован αντιγραφ απαγορ"),
    "liability": (2, "liab warrant virus viruses views opinions haft gewähr responsabil responsable respons aansprak ответственност ευθύν disclaimer"),
    "subscription": (4, "unsubscrib subscrib abbestell abmeld abonnier désabonn désinscri abonn baja suscri cancelar inscri disiscri iscri afmeld uitschrijv отпис подпис διαγραφή εγγραφ"),
    "list": (1, "list newsletter mailingliste verteiler liste lista boletín infolettre lijst nieuwsbrief рассылк λίστα"),
    "law": (2, "legal law lawful gesetz rechtlich registered registergericht handelsregister geschäftsführer ley legge juridique wettelijk закон νόμο"),
}
#: The same in scripts without spaces or with joined words: anywhere in a text, ``_`` for a space.
NOTICE_PARTS = {
    "message": (1, "邮件 郵件 メール 메일 الرسالة البريد संदेश ईमेल मेल จดหมาย ข้อความ อีเมล"),
    "sender": (1, "发件人 寄件人 送信者 발신자 المرسل प्रेषक भेजने ผู้ส่ง"),
    "recipient": (2, "收件人 收信人 宛先 受信者 宛てた 수신자 للمرسل_إليه المرسل_إليه المستلم पाने_वाले प्राप्तकर्ता ผู้รับ"),
    "error": (2, "误收 误发 誤收 错误 誤って 誤送 手違い 잘못 خطأ بالخطأ भूल गलती ผิดพลาด โดยไม่ตั้งใจ"),
    "delete": (2, "删除 刪除 销毁 削除 破棄 삭제 احذف حذف إتلاف मिटा हटा नष्ट ลบ ทำลาย"),
    "secret": (2, "机密 機密 保密 秘密 기밀 سري गोपनीय ความลับ"),
    "spread": (2, "转发 轉發 传播 复制 披露 転送 複製 開示 漏洩 무단 배포 نشر نسخ توزيع वितरण प्रसार प्रतिलिपि เผยแพร่ คัดลอก ส่งต่อ"),
    "liability": (2, "责任 責任 책임 مسؤولية المسؤولية उत्तरदायी ज़िम्मेदार जिम्मेदार รับผิดชอบ"),
    "subscription": (4, "退订 退訂 订阅 訂閱 購読 配信停止 登録解除 구독 수신거부 الاشتراك सदस्यता ยกเลิกการรับ สมัครรับ"),
    "list": (1, "邮件列表 メーリングリスト メルマガ القائمة_البريدية मेलिंग_सूची รายชื่ออีเมล จดหมายข่าว"),
    "law": (2, "法律 法令 법률 القانون कानून กฎหมาย"),
}
#: First fields of the headers that stand above a quoted message.
QUOTED_FIELDS = frozenset(
    "From Sent To Cc Subject Date Von Gesendet An Betreff Datum De Envoyé À Objet Enviado Para Asunto От Отправлено Кому Тема Από Προς Θέμα 发件人 发送时间 收件人 主题 差出人 送信日時 宛先 件名".split()
)
#: Thai word classes, as far as they decide what a space parts; the words themselves are found with a general dictionary.
#: Particles that end a sentence.
THAI_FINALS = frozenset("ครับ ครับผม ค่ะ คะ นะ นะครับ นะคะ จ้ะ จ๊ะ จ้า ฮะ ล่ะ".split())
#: Subjects, titles, question words and connectors that open a clause of their own.
THAI_SUBJECTS = frozenset(
    "เรา ผม กระผม ฉัน ดิฉัน ข้าพเจ้า เขา เธอ ท่าน คุณ พวกเรา พวกเขา พวกคุณ ใคร ทุกคน ทุกท่าน ดร นาย นาง นางสาว อาจารย์ ศาสตราจารย์ พี่ น้อง แม่ พ่อ มัน ทำไม อะไร เมื่อไร เมื่อไหร่ "
    "ดังนั้น เพราะฉะนั้น ฉะนั้น อย่างไรก็ตาม อย่างไรก็ดี นอกจากนี้ นอกจากนั้น อนึ่ง ทั้งนี้ ต่อมา จากนั้น หลังจากนั้น สุดท้าย วันนี้ พรุ่งนี้ เมื่อวาน เมื่อวานนี้ เมื่อเช้า เมื่อคืน ตอนนี้ ขณะนี้ ปัจจุบัน".split()
)
#: Words of request and prohibition.
THAI_REQUESTS = frozenset("กรุณา โปรด ช่วย ขอ ขอให้ ขอเชิญ เชิญ อย่า ห้าม รบกวน ขอบคุณ ขออภัย ขอโทษ".split())
#: Words that open a clause which leans on another.
THAI_LEANING = frozenset("หาก ถ้า ถ้าหาก เมื่อ หลังจาก ก่อนที่ ขณะที่ ในขณะที่ แม้ แม้ว่า ถึงแม้ ถึงแม้ว่า เนื่องจาก เพราะ หลัง ก่อน ระหว่าง".split())
#: Conjunctions, prepositions and the like: neither before nor after them does a sentence end.
THAI_TIES = frozenset(
    "และ หรือ หรือว่า กับ แต่ ที่ ซึ่ง อัน เพื่อ เพื่อให้ โดย จาก ใน บน ใต้ ว่า จน จนถึง จนกระทั่ง จึง ก็ รวมทั้ง รวมถึง ตลอดจน อีกทั้ง ทั้ง ตาม แก่ แด่ ต่อ ณ สำหรับ คือ ได้แก่ เช่น เป็น ของ ภายใน ภายใต้ ภายนอก ตั้งแต่ ถึง แห่ง "
    "เกี่ยวกับ ใกล้ ข้าง เหนือ ริม เพราะว่า เพราะ เนื่องจาก โดยเฉพาะ พร้อม พร้อมทั้ง พร้อมกับ ด้วย ตอน หลัง ก่อน ระหว่าง ราว ประมาณ".split()
)
#: Ties that may also stand at the end of a sentence.
THAI_TRAILING = frozenset("ใกล้ ข้าง ด้วย พร้อม ก่อน หลัง เหนือ ใต้ ตาม ต่อ".split())
#: Words before the verb, and words that follow one: neither opens a sentence; the first kind tells of a verb.
THAI_AUXILIARIES = frozenset("จะ ยัง ไม่ ไม่ได้ ต้อง กำลัง เคย ควร ควรจะ อาจ อาจจะ คง คงจะ น่า น่าจะ สามารถ มัก มักจะ เพิ่ง ย่อม ถูก ได้รับ".split())
THAI_AFTER = frozenset("แล้ว ไป มา ได้ อยู่ ให้ ไว้ เลย อีก เท่านั้น กัน เอง นี้ นั้น ไหม หรือไม่ หรือยัง ทันที เสมอ มาก ๆ ฯลฯ ฯ".split())
#: Verbs that follow other verbs as well; alone they are the verb.
THAI_LIGHT = frozenset("ไป มา ได้ อยู่ ให้ เป็น คือ เข้า ออก ขึ้น ลง".split())
#: Before these a verb is part of a noun or of a clause inside another.
THAI_NOMINAL = frozenset("การ ความ ผู้ นัก ช่าง เครื่อง คำ วิธี ที่ ซึ่ง อัน เพื่อ ตอน ก่อน หลัง".split())
#: Before these 'of' is the noun 'things'.
THAI_QUALITIES = frozenset("เก่า ใหม่ ดี หาย แพง ถูก ใช้ เล่น กิน ฝาก แท้ ปลอม สด แห้ง หนัก".split())
THAI_VERBS = frozenset(
    "มี ไม่มี พบ เจอ เห็น ดู มอง อ่าน เขียน ฟัง ได้ยิน พูด บอก ถาม ตอบ เล่า อธิบาย แจ้ง เตือน รายงาน ประกาศ เสนอ แนะนำ ปรึกษา คุย สนทนา โทร เรียก เชิญ ร้องเรียน ขอ ขอร้อง สั่ง อนุญาต อนุมัติ ยืนยัน ยอมรับ ปฏิเสธ ตกลง สัญญา "
    "ส่ง รับ ให้ เอา นำ พา ถือ ยก วาง ใส่ หยิบ จับ ย้าย ขน เก็บ ทิ้ง ลบ เพิ่ม ลด เปลี่ยน แก้ แก้ไข ซ่อม ซ่อมแซม ปรับ ปรับปรุง พัฒนา สร้าง ทำ จัด จัดการ จัดทำ เตรียม ตั้ง ติดตั้ง ติด ถอด เปิด ปิด เริ่ม เริ่มต้น หยุด เลิก จบ เสร็จ เลื่อน ยกเลิก "
    "ซื้อ ขาย จ่าย ชำระ โอน ยืม คืน เช่า จอง คิด นับ วัด คำนวณ ตรวจ ตรวจสอบ ทดสอบ ทดลอง สำรวจ วิเคราะห์ ศึกษา วิจัย เรียน สอน ฝึก อบรม ประชุม พิจารณา ตัดสิน ตัดสินใจ เลือก วางแผน ติดตาม ค้นหา หา ค้น พยายาม "
    "ใช้ ต้องการ อยาก ชอบ รัก เกลียด กลัว หวัง เชื่อ รู้ รู้จัก ทราบ เข้าใจ จำ ลืม สนใจ คาด คาดว่า รู้สึก ดีใจ เสียใจ กังวล โกรธ เหนื่อย หิว ป่วย ตาย เกิด เกิดขึ้น หาย เสีย พัง แตก ขาด เหลือ รั่ว ไหม้ ล้ม ตก ชน ไหล ดับ "
    "กิน ดื่ม นอน ตื่น นั่ง ยืน เดิน วิ่ง ขับ ขี่ บิน ว่าย เดินทาง กลับ ถึง มาถึง เข้า ออก ผ่าน ข้าม ขึ้น ลง ตาม รอ คอย อยู่ พัก อาศัย เยี่ยม ต้อนรับ พบปะ แต่งงาน เล่น ร้อง เต้น ทำงาน ทำอาหาร ปลูก เลี้ยง ตัด ล้าง ซัก ทำความสะอาด "
    "ช่วย ช่วยเหลือ สนับสนุน ร่วม เข้าร่วม ร่วมมือ แข่ง ชนะ แพ้ ผลิต ส่งออก นำเข้า บริการ ดำเนิน ดำเนินการ ปฏิบัติ ควบคุม ป้องกัน รักษา คุ้มครอง กำหนด ระบุ แสดง ปรากฏ ประกอบ รวม แบ่ง แยก ต่อ เชื่อม กลายเป็น ทำให้ หมายถึง เท่ากับ "
    "วางสาย สมัคร ลงทะเบียน ลงนาม เซ็น พิมพ์ ถ่าย บันทึก แปล ลา ลาออก แต่งตั้ง เลือกตั้ง บริจาค ลงทุน กู้ ขาดทุน เติบโต ล่าช้า มาสาย ชำรุด หมด หมดอายุ สำเร็จ ล้มเหลว เพียงพอ ครบ ดี แพง สวย ร้อน หนาว".split()
)
#: The same for Lao.
LAO_FINALS = frozenset("ເດີ້ ເດີ ແດ່ ເນາະ ເອີຍ ຈ້າ ດອກ ແທ້".split())
LAO_SUBJECTS = frozenset(
    "ຂ້ອຍ ຂ້າພະເຈົ້າ ເຮົາ ພວກເຮົາ ລາວ ເຂົາ ເຂົາເຈົ້າ ພວກເຂົາ ເຈົ້າ ທ່ານ ທຸກຄົນ ໃຜ ແມ່ ພໍ່ ອ້າຍ ເອື້ອຍ ນ້ອງ ມັນ ຫຍັງ ເປັນຫຍັງ ດັ່ງນັ້ນ ສະນັ້ນ ນອກຈາກນັ້ນ ນອກຈາກນີ້ ຕໍ່ມາ ຈາກນັ້ນ ຫຼັງຈາກນັ້ນ ມື້ນີ້ ມື້ອື່ນ ມື້ວານ ມື້ວານນີ້ ຕອນນີ້ ປັດຈຸບັນ".split()
)
LAO_REQUESTS = frozenset("ກະລຸນາ ຂໍ ຂໍໃຫ້ ເຊີນ ຢ່າ ຫ້າມ ຊ່ວຍ ຂອບໃຈ ຂໍໂທດ".split())
LAO_LEANING = frozenset("ຖ້າ ຖ້າຫາກ ຫາກ ເມື່ອ ຫຼັງຈາກ ກ່ອນ ຂະນະທີ່ ເຖິງແມ່ນ ເຖິງແມ່ນວ່າ ເນື່ອງຈາກ ເພາະ ເພາະວ່າ ລະຫວ່າງ".split())
LAO_TIES = frozenset(
    "ແລະ ຫຼື ກັບ ແຕ່ ທີ່ ຊຶ່ງ ເຊິ່ງ ເພື່ອ ໂດຍ ຈາກ ໃນ ເທິງ ໃຕ້ ວ່າ ຈົນ ຈຶ່ງ ກໍ ກໍ່ ລວມທັງ ທັງ ຕາມ ຕໍ່ ສຳລັບ ຄື ໄດ້ແກ່ ເຊັ່ນ ເປັນ ຂອງ ພາຍໃນ ຕັ້ງແຕ່ ເຖິງ ແຫ່ງ ກ່ຽວກັບ ໃກ້ ຂ້າງ ພ້ອມ ດ້ວຍ ເພາະ ເພາະວ່າ ເນື່ອງຈາກ ກ່ອນ ລະຫວ່າງ ປະມານ".split()
)
LAO_TRAILING = frozenset("ໃກ້ ຂ້າງ ດ້ວຍ ພ້ອມ ກ່ອນ ໃຕ້ ຕາມ ຕໍ່".split())
LAO_AUXILIARIES = frozenset("ຈະ ຍັງ ບໍ່ ບໍ່ໄດ້ ຕ້ອງ ກຳລັງ ເຄີຍ ຄວນ ອາດ ອາດຈະ ຄົງ ສາມາດ ມັກຈະ ຖືກ ໄດ້ຮັບ".split())
LAO_AFTER = frozenset("ແລ້ວ ໄປ ມາ ໄດ້ ຢູ່ ໃຫ້ ໄວ້ ເລີຍ ອີກ ເທົ່ານັ້ນ ກັນ ເອງ ນີ້ ນັ້ນ ບໍ ທັນທີ ສະເໝີ ຫຼາຍ ໆ ຯລຯ".split())
LAO_LIGHT = frozenset("ໄປ ມາ ໄດ້ ຢູ່ ໃຫ້ ເປັນ ຄື ເຂົ້າ ອອກ ຂຶ້ນ ລົງ".split())
LAO_NOMINAL = frozenset("ການ ຄວາມ ຜູ້ ນັກ ຊ່າງ ເຄື່ອງ ຄຳ ວິທີ ທີ່ ຊຶ່ງ ເຊິ່ງ ເພື່ອ ຕອນ ກ່ອນ".split())
LAO_VERBS = frozenset(
    "ມີ ບໍ່ມີ ພົບ ເຫັນ ເບິ່ງ ອ່ານ ຂຽນ ຟັງ ເວົ້າ ບອກ ຖາມ ຕອບ ເລົ່າ ແຈ້ງ ເຕືອນ ລາຍງານ ປະກາດ ສະເໜີ ແນະນຳ ໂທ ເອີ້ນ ຂໍ ສັ່ງ ອະນຸຍາດ ຢືນຢັນ ຍອມຮັບ ຕົກລົງ ສົ່ງ ຮັບ ເອົາ ນຳ ພາ ຖື ວາງ ໃສ່ ຈັບ ຍ້າຍ ເກັບ ຖິ້ມ ລຶບ ເພີ່ມ ຫຼຸດ ປ່ຽນ ແກ້ ແກ້ໄຂ ສ້ອມແປງ "
    "ປັບປຸງ ພັດທະນາ ສ້າງ ເຮັດ ຈັດ ຈັດການ ກຽມ ຕັ້ງ ຕິດຕັ້ງ ຖອດ ເປີດ ປິດ ເລີ່ມ ຢຸດ ຈົບ ສຳເລັດ ຊື້ ຂາຍ ຈ່າຍ ຊຳລະ ໂອນ ຢືມ ຄືນ ເຊົ່າ ຈອງ ຄິດ ນັບ ວັດ ກວດ ກວດສອບ ທົດສອບ ສຶກສາ ຮຽນ ສອນ ຝຶກ ປະຊຸມ ພິຈາລະນາ ຕັດສິນ ເລືອກ ຕິດຕາມ ຊອກຫາ "
    "ໃຊ້ ຕ້ອງການ ຢາກ ມັກ ຮັກ ຊັງ ຢ້ານ ຫວັງ ເຊື່ອ ຮູ້ ຮູ້ຈັກ ເຂົ້າໃຈ ຈື່ ລືມ ສົນໃຈ ຮູ້ສຶກ ດີໃຈ ເສຍໃຈ ເມື່ອຍ ຫິວ ປ່ວຍ ຕາຍ ເກີດ ຫາຍ ເສຍ ແຕກ ຂາດ ເຫຼືອ ຕົກ ໄຫຼ ກິນ ດື່ມ ນອນ ຕື່ນ ນັ່ງ ຢືນ ຍ່າງ ແລ່ນ ຂັບ ຂີ່ ບິນ ເດີນທາງ ກັບ ຮອດ ມາຮອດ ຜ່ານ ຂ້າມ "
    "ລໍ ລໍຖ້າ ພັກ ອາໄສ ຢ້ຽມຢາມ ຕ້ອນຮັບ ແຕ່ງງານ ຫຼິ້ນ ຮ້ອງ ເຕັ້ນ ເຮັດວຽກ ປູກ ລ້ຽງ ຕັດ ລ້າງ ຊ່ວຍ ຊ່ວຍເຫຼືອ ສະໜັບສະໜູນ ເຂົ້າຮ່ວມ ຮ່ວມມື ແຂ່ງ ຊະນະ ແພ້ ຜະລິດ ບໍລິການ ດຳເນີນ ປະຕິບັດ ຄວບຄຸມ ປ້ອງກັນ ຮັກສາ ກຳນົດ ສະແດງ ແບ່ງ ແຍກ ໝາຍເຖິງ ລົງທະບຽນ ເຊັນ ພິມ ບັນທຶກ ແປ ດີ ແພງ ງາມ ຮ້ອນ ໜາວ".split()
)


@dataclass(frozen=True)
class Clauses:
    """The word classes of a script that parts sentences by spaces."""

    finals: frozenset
    subjects: frozenset
    requests: frozenset
    leaning: frozenset
    ties: frozenset
    trailing: frozenset
    auxiliaries: frozenset
    after: frozenset
    light: frozenset
    nominal: frozenset
    things: frozenset
    qualities: frozenset
    verbs: frozenset

    def words(self) -> frozenset[str]:
        """All words of the classes, for the lattice."""
        return frozenset().union(*(getattr(self, f.name) for f in fields(self) if f.name not in ("nominal", "things", "qualities")))


CLAUSES = {
    "thai": Clauses(THAI_FINALS, THAI_SUBJECTS, THAI_REQUESTS, THAI_LEANING, THAI_TIES, THAI_TRAILING, THAI_AUXILIARIES, THAI_AFTER, THAI_LIGHT, THAI_NOMINAL, frozenset(["ของ"]), THAI_QUALITIES, THAI_VERBS),
    "lao": Clauses(LAO_FINALS, LAO_SUBJECTS, LAO_REQUESTS, LAO_LEANING, LAO_TIES, LAO_TRAILING, LAO_AUXILIARIES, LAO_AFTER, LAO_LIGHT, LAO_NOMINAL, frozenset(), frozenset(), LAO_VERBS),
}
#: After a closing quotation mark these words carry the sentence on.
CJK_CARRY_ON = frozenset("と って という といって といった とか と言って と聞いて 就 然后 然後 便 说 說 道 问 問".split())
CJK_WORDS = frozenset("とても ときどき とき ところ ところが となり とりあえず 就是 就算 便宜 说明 道路 问题".split())
# --- end of fixed values ----------------------------------------------------------------------------------------------
