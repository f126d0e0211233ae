"""The domain taxonomy that ships with the engine (MAP1); `taxonomy` has what is done with it."""

from __future__ import annotations

#: What each domain is, and its aspect categories in order.
DOMAINS = {
    "Restoran/Ovqatlanish": ("Restaurants, fast food, cafes, national cuisine", ("ovqat_sifati", "xizmat_ko'rsatish", "narx", "tozalik", "muhit", "tezlik", "menyu_xilma-xilligi", "joylashuv", "porsiya")),
    "Bank/Moliya": ("Banks, financial services, loans", ("xizmat_ko'rsatish", "ilova_qulayligi", "kredit", "foiz_stavka", "tezlik", "xavfsizlik", "filial", "qo'llab-quvvatlash", "karta_xizmati", "onlayn_xizmat")),
    "To'lov tizimlari": ("Mobile payment, fintech, digital wallets", ("ilova_qulayligi", "tezlik", "xavfsizlik", "qo'llab-quvvatlash", "komissiya", "funksionallik", "ishonchlilik")),
    "Telekommunikatsiya": ("Mobile operators, internet service providers", ("internet_sifati", "aloqa_sifati", "narx", "qo'llab-quvvatlash", "qamrov", "tezlik", "ilova_qulayligi")),
    "Elektron tijorat": ("Online marketplaces, e-commerce platforms", ("mahsulot_sifati", "yetkazib_berish", "narx", "qo'llab-quvvatlash", "tanlov", "qaytarish", "ilova_qulayligi", "to'lov")),
    "Oziq-ovqat do'konlari": ("Supermarkets, grocery stores, retail chains", ("mahsulot_sifati", "narx", "xizmat_ko'rsatish", "tozalik", "tanlov", "joylashuv", "navbat")),
    "Tibbiyot/Sog'liqni saqlash": ("Hospitals, clinics, pharmacies, healthcare", ("shifokor_malakasi", "xizmat_ko'rsatish", "narx", "tozalik", "diagnostika", "navbat", "jihozlar", "dori", "qo'llab-quvvatlash")),
    "Ta'lim": ("Universities, schools, courses, training centers", ("o'qitish_sifati", "o'qituvchi", "narx", "dastur", "infratuzilma", "natija", "sertifikat", "amaliyot")),
    "Gul/Sovg'a": ("Flower shops, gift stores", ("sifat", "narx", "yetkazib_berish", "xizmat_ko'rsatish", "tanlov", "tezlik")),
    "Sport/Fitnes": ("Gyms, fitness centers, sports facilities", ("jihozlar", "murabbiy", "narx", "tozalik", "muhit", "joylashuv")),
    "Sayohat/Turizm": ("Airlines, hotels, travel agencies, resorts", ("xizmat_ko'rsatish", "narx", "qulaylik", "tozalik", "ovqat_sifati", "joylashuv", "xodimlar")),
    "Yetkazib berish": ("Delivery services, ride-hailing, logistics", ("tezlik", "narx", "xizmat_ko'rsatish", "ilova_qulayligi", "ishonchlilik", "xavfsizlik")),
    "Go'zallik": ("Beauty salons, cosmetics, barbershops", ("sifat", "narx", "tozalik", "mutaxassislik", "muhit")),
    "Kitob/Nashriyot": ("Bookstores, publishing houses", ("tanlov", "narx", "sifat", "xizmat_ko'rsatish", "yetkazib_berish")),
    "Texnologiya/Media": ("Tech platforms, media, news outlets", ("kontent_sifati", "ilova_qulayligi", "ishonchlilik", "reklama", "qo'llab-quvvatlash")),
    "Transport/Yo'l": ("Transport, roads, auto services", ("sifat", "narx", "xavfsizlik", "qulaylik", "tezlik")),
    "Ko'ngilochar": ("Entertainment, parks, cinema, theater", ("ko'ngilochar_sifati", "narx", "xizmat_ko'rsatish", "muhit", "tozalik")),
    "Boshqa": ("Other / miscellaneous", ("sifat", "narx", "xizmat_ko'rsatish", "qo'llab-quvvatlash")),
}
