"""Word lists of the two-axis classifier. Terms are matched as substrings of normalised text."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """Lists in order of precedence: the first term of a list that occurs is the one reported."""

    decisive: tuple[str, ...]
    test_strong: tuple[str, ...]
    test_weak: tuple[str, ...]
    checkpoint_strong: tuple[str, ...]
    checkpoint_weak: tuple[str, ...]
    driving: tuple[str, ...]
    enforcement: tuple[str, ...]
    crash: tuple[str, ...]
    alcohol: tuple[str, ...]
    campaign: tuple[str, ...]
    negative: tuple[str, ...]
    place_guard: tuple[str, ...]
    evergreen: tuple[str, ...]
    soft_block: tuple[str, ...]
    hard_block: tuple[str, ...]


# The Thai lists of the classifier.
THAI = Lexicon(
    decisive=(
        "เมาแล้วขับ", "เมาแล้วขี่", "เมาขับ", "เมาขี่", "เมาซิ่ง", "เมาแล้วซิ่ง", "เมาแล้วชน",
        "ดื่มแล้วขับ", "ดื่มแล้วขี่", "ขับขณะเมาสุรา", "ขับรถขณะเมาสุรา", "ขับขี่ขณะเมาสุรา",
        "ขับรถขณะมึนเมา", "เมาแล้วขับรถ", "เมาแอ๋ขับ", "เมาหลับคารถ",
    ),
    test_strong=(
        "เป่าแอลกอฮอล์", "เป่าวัดแอลกอฮอล์", "เป่าแอลฯ", "เป่าเมา", "เป่าทะลุ",
        "ตรวจวัดแอลกอฮอล์", "ตรวจวัดปริมาณแอลกอฮอล์", "วัดปริมาณแอลกอฮอล์",
        "ทดสอบปริมาณแอลกอฮอล์", "มิลลิกรัมเปอร์เซ็นต์", "มิลลิกรัมเปอร์เซนต์",
        "มก.%", "มก.เปอร์เซ็นต์",
        "ปฏิเสธเป่า", "ไม่ยอมเป่า", "ไม่เป่าแอลกอฮอล์", "ปฏิเสธการเป่า", "ปฏิเสธตรวจวัดแอลกอฮอล์",
    ),
    test_weak=("ตรวจแอลกอฮอล์", "วัดแอลกอฮอล์", "แอลกอฮอล์ในเลือด", "ปริมาณแอลกอฮอล์ในร่างกาย", "ระดับแอลกอฮอล์", "ค่าแอลกอฮอล์"),
    checkpoint_strong=(
        "ด่านตรวจแอลกอฮอล์", "ด่านแอลกอฮอล์", "ด่านตรวจวัดแอลกอฮอล์", "ด่านวัดแอลกอฮอล์",
        "จุดตรวจวัดแอลกอฮอล์", "จุดตรวจแอลกอฮอล์", "ด่านตรวจเมา", "ด่านเมาไม่ขับ",
        "ด่านตรวจวัดระดับแอลกอฮอล์",
    ),
    checkpoint_weak=("ตั้งด่าน", "จุดตรวจ", "ด่านตรวจ", "ด่านจราจร", "แหกด่าน", "หนีด่าน", "ฝ่าด่าน", "เข้าด่าน", "เจอด่าน", "จุดสกัด"),
    driving=(
        "ขับ", "ขี่", "คนขับ", "ผู้ขับขี่", "ผู้ขับ", "ใบขับขี่", "โชเฟอร์", "ซิ่ง", "จราจร",
        "รถยนต์", "เก๋ง", "กระบะ", "ปิกอัพ", "จยย", "จักรยานยนต์", "มอเตอร์ไซค์", "บิ๊กไบค์",
        "รถบรรทุก", "รถตู้", "รถพ่วง", "รถหรู", "ไรเดอร์", "ตุ๊กตุ๊ก", "แท็กซี่",
    ),
    enforcement=(
        "จับกุม", "ถูกจับ", "รวบ", "ดำเนินคดี", "แจ้งข้อหา", "ตั้งข้อหา", "ส่งฟ้อง", "สั่งฟ้อง",
        "เปรียบเทียบปรับ", "คุมประพฤติ", "บำเพ็ญประโยชน์", "ริบรถ", "ยึดใบขับขี่",
        "พักใช้ใบขับขี่", "เพิกถอนใบขับขี่", "จำคุก", "ประกันตัว", "พ.ร.บ.จราจร", "ศาล",
    ),
    crash=(
        "ชน", "เฉี่ยวชน", "พุ่งชน", "เสยท้าย", "คว่ำ", "พลิกคว่ำ", "ตกข้างทาง", "ตกถนน",
        "อุบัติเหตุ", "ดับคาที่", "ดับสลด", "ดับ 1", "ดับ 2", "ดับ 3", "เสียชีวิต",
        "บาดเจ็บ", "สาหัส", "โคม่า", "เจ็บ",
    ),
    alcohol=("เมา", "มึนเมา", "แอลกอฮอล์", "แอลฯ", "กลิ่นเหล้า", "กลิ่นสุรา", "ดื่มสุรา", "ดื่มเหล้า", "ดื่มเบียร์", "น้ำเมา", "เมาสุรา", "นักดื่ม"),
    campaign=("เมาไม่ขับ", "ดื่มไม่ขับ", "ดื่มไม่ขี่", "เมาไม่ขี่", "ขับไม่ดื่ม", "7วันอันตราย", "เจ็ดวันอันตราย", "ด่านปากหวาน"),
    negative=(
        "เมารถ", "เมาเรือ", "เมาคลื่น", "เมาเครื่องบิน", "เมาหมัด", "เมามวย", "เมารัก",
        "เมาอำนาจ", "เมายศ", "เมาท์", "เมาแล้วเดิน", "เมาแล้วนอน",
        "เมากัญชา", "เมายาบ้า", "เมายา",
        "เจลแอลกอฮอล์", "สเปรย์แอลกอฮอล์", "แอลกอฮอล์ล้างมือ", "แอลกอฮอล์ฆ่าเชื้อ",
        "แอลกอฮอล์ทางการแพทย์", "ไร้แอลกอฮอล์", "ปราศจากแอลกอฮอล์", "แอลกอฮอล์0%",
        "ภาษีสุรา", "ภาษีเบียร์", "สรรพสามิต", "สุราเถื่อน", "เหล้าเถื่อน", "สุราชุมชน",
        "ใบอนุญาตขายสุรา", "พ.ร.บ.สุรา", "พ.ร.บ.ควบคุมเครื่องดื่มแอลกอฮอล์",
        "ขายเหล้า", "ขายสุรา", "ลักลอบขายสุรา", "เหล้าปลอม", "โรงเบียร์",
        "คราฟต์เบียร์", "โรงงานสุรา",
        "เครื่องวัดแอลกอฮอล์", "เครื่องเป่าแอลกอฮอล์", "เครื่องตรวจแอลกอฮอล์",
        "ด่านลอย",
    ),
    place_guard=("สุราษฎร์ธานี", "สุราษฎร์"),
    evergreen=(
        "โทษเท่าไหร่", "มีโทษอย่างไร", "เปิดอัตราโทษ", "ค่าปรับเท่าไร", "สรุปกฎหมาย",
        "อัพเดทกฎหมาย", "อัปเดตกฎหมาย", "กี่ชั่วโมง", "กี่ช็อต", "ตรวจไม่เจอ",
        "เช็กข่าวชัวร์", "เช็คข่าวชัวร์", "จริงหรือ", "วิธีเลี่ยง", "ทำไงดี",
        "คุ้มครองหรือไม่", "รู้ไว้ก่อน", "ต้องรู้",
    ),
    soft_block=("facebook.com", "tiktok.com", "youtube.com", "x.com", "twitter.com", "instagram.com"),
    hard_block=("vietnam.vn",),
)

# Words of the given documents in the same roles, so the classifier can be held against SQL on them.
SAMPLE = Lexicon(
    decisive=("idiot", "moron", "stupid"),
    test_strong=("license", "apache"),
    test_weak=("token",),
    checkpoint_strong=("nicht", "keit"),
    checkpoint_weak=("schen", "heit"),
    driving=("the", "und"),
    enforcement=("tion", "lich"),
    crash=("ing", "ung"),
    alcohol=("and", "der"),
    campaign=("que", "les"),
    negative=("ent", "ver"),
    place_guard=("thent", "eraver"),
    evergreen=("ous", "mente"),
    soft_block=("src1",),
    hard_block=("src19",),
)

# Provinces with common names, and areas that lie in one.
PROVINCES = (
    "กรุงเทพมหานคร", "กระบี่", "กาญจนบุรี", "กาฬสินธุ์", "กำแพงเพชร", "ขอนแก่น",
    "จันทบุรี", "ฉะเชิงเทรา", "ชลบุรี", "ชัยนาท", "ชัยภูมิ", "ชุมพร", "เชียงราย",
    "เชียงใหม่", "ตรัง", "ตราด", "ตาก", "นครนายก", "นครปฐม", "นครพนม", "นครราชสีมา",
    "นครศรีธรรมราช", "นครสวรรค์", "นนทบุรี", "นราธิวาส", "น่าน", "บึงกาฬ", "บุรีรัมย์",
    "ปทุมธานี", "ประจวบคีรีขันธ์", "ปราจีนบุรี", "ปัตตานี", "พระนครศรีอยุธยา", "พะเยา",
    "พังงา", "พัทลุง", "พิจิตร", "พิษณุโลก", "เพชรบุรี", "เพชรบูรณ์", "แพร่", "ภูเก็ต",
    "มหาสารคาม", "มุกดาหาร", "แม่ฮ่องสอน", "ยโสธร", "ยะลา", "ร้อยเอ็ด", "ระนอง",
    "ระยอง", "ราชบุรี", "ลพบุรี", "ลำปาง", "ลำพูน", "เลย", "ศรีสะเกษ", "สกลนคร",
    "สงขลา", "สตูล", "สมุทรปราการ", "สมุทรสงคราม", "สมุทรสาคร", "สระแก้ว", "สระบุรี",
    "สิงห์บุรี", "สุโขทัย", "สุพรรณบุรี", "สุราษฎร์ธานี", "สุรินทร์", "หนองคาย",
    "หนองบัวลำภู", "อ่างทอง", "อำนาจเจริญ", "อุดรธานี", "อุตรดิตถ์", "อุทัยธานี", "อุบลราชธานี",
    "กทม", "กทม.", "โคราช", "พัทยา", "หาดใหญ่",
)
AREAS = {
    "สน.": "กรุงเทพมหานคร", "ทองหล่อ": "กรุงเทพมหานคร", "ลาดพร้าว": "กรุงเทพมหานคร", "รามคำแหง": "กรุงเทพมหานคร",
    "บางนา": "กรุงเทพมหานคร", "ดินแดง": "กรุงเทพมหานคร", "สุขุมวิท": "กรุงเทพมหานคร", "รัชดา": "กรุงเทพมหานคร",
    "พระราม 2": "กรุงเทพมหานคร", "วิภาวดี": "กรุงเทพมหานคร", "กล้วยน้ำไท": "กรุงเทพมหานคร", "บางบัวทอง": "นนทบุรี",
    "ปากเกร็ด": "นนทบุรี", "รังสิต": "ปทุมธานี", "ลำลูกกา": "ปทุมธานี", "ศรีราชา": "ชลบุรี", "บางแสน": "ชลบุรี",
    "แหลมฉบัง": "ชลบุรี", "หัวหิน": "ประจวบคีรีขันธ์", "ปากช่อง": "นครราชสีมา", "แม่สอด": "ตาก", "เบตง": "ยะลา",
    "สมุย": "สุราษฎร์ธานี", "ป่าตอง": "ภูเก็ต", "สุวรรณภูมิ": "สมุทรปราการ", "ดอนเมือง": "กรุงเทพมหานคร",
}
