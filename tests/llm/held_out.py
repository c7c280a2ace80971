"""Sentences written apart from the labelled table, to measure the personal-information model.

``<e:...>`` marks an e-mail address, ``p`` a phone number, ``i`` an identity number, ``s`` a street
address and ``n`` a name of a person.
"""

import re

KINDS = {"e": "email", "p": "phone", "i": "identity_number", "s": "street_address", "n": "person_name"}

MARKED = """My SSN is <i:412-55-8821>, please delete it from your files.
My passport number is <i:533380006> and it expires next year.
Driver's licence <i:D1234567> was copied at the counter.
We moved from <s:45 Maple Crescent>, Toronto, a year ago.
<n:John Smith> or <n:Mary Jones> will pick it up.
Use <e:anna.keller@firma.de> or <e:info@keller-moebel.de> for the bill.
<n:Jennifer O'Connor> signed for it.
Our Sydney desk is at <p:+61 2 9374 4000> until five.
Send it to <s:18 Birchwood Avenue> please.
I gave the receipt to <n:Margaret Thatcher-Hughes> at the till.
Reach the landlord, <n:Walter Pym>, at <p:(617) 867-5309>.
Delivered to <s:PO Box 4417> although I asked for the door.
Write to <e:k.osei99@mail.co.uk> with the tracking code.
The technician <n:Samuel Okafor> could not find the fault.
Kind regards, <n:Eleanor Vance>
My phone is <p:0161 496 0123>, leave a message.
The form shows my national insurance number <i:QQ 12 34 56 C> to everybody.
I live at <s:221B Baker Street> and never got it.
Please call <n:Mr Obi> back, he waited all day.
<n:Ravi Menon> says hello.
They mailed a catalogue to <n:Lucy Chen>, <s:900 West Harbor Drive>.
Text me on <p:415.555.2671> when it is ready.
Ask for <n:Beatrice> in the back office.
It went to <s:77 Old Quarry Road, Apt 12> again.
Contact <e:sales (at) tinyshop.org> for spare parts.
ID number <i:9203-11-5521-08> does not belong on a parcel.
<n:D. Whitfield> repaired mine in ten minutes.
Meine Nummer lautet <p:0221 4710 815>, bitte nur abends.
Frau <n:Schimmelpfennig> aus der Buchhaltung war sehr freundlich.
Bitte liefern an <n:Torsten Ahlers>, <s:Lindenstraße 14>.
Die Ausweisnummer <i:L01X00T47> stand offen auf dem Brief.
Viele Grüße, <n:Kerstin Vogt>
Ich wohne in der <s:Goethestr. 8a> im dritten Stock.
Mi número es el <p:612 345 678>, llamen por la mañana.
La señora <n:Inés Carrasco> me cambió la pieza.
Mi DNI es <i:53412877K> y no lo quiero ver impreso.
Vivo en <s:Calle Mayor 12, 3º B> desde hace poco.
Saludos, <n:Joaquín Ferrer>
Appelez le <p:06 12 34 56 78> après midi.
Mme <n:Delacroix> du magasin a tout réglé.
Le colis est resté au <s:12 rue des Lilas> trois jours.
Ma carte d'identité <i:880692310285> a été photocopiée.
Bien à vous, <n:Mathilde Perrin>
Écrivez à <e:mathilde.perrin@poste.fr> si besoin.
Мой номер <p:+7 495 123-45-67>, звоните вечером.
電話番号は<p:03-1234-5678>です。
我的邮箱是<e:liwei88@mail.example>，谢谢。
The kettle boils in three minutes and the lid stays cool.
Order 302-5567812-9902134 never arrived.
The Brennan & Cole toaster burns everything.
Serial SN4471029981 is printed under the base.
I paid $49.99 and would pay it again on 12/03/2022.
Version 2.14.7 drains the battery faster than 2.14.6 did.
Great packaging, awful smell, average sound.
Monday came and went, and on Tuesday the courier rang twice.
My sister says the blue one looks nicer in daylight.
See www.example.net/faq/22 for the washing instructions.
In Boston it rained all week, so the jacket got a real test.
Der Verschluss klemmt und das Netzteil summt ein wenig.
Nach vier Wochen war die Naht offen, schade um das Geld.
La cremallera se atascó y el vendedor no quiso saber nada.
Le mode d'emploi est illisible et la couture part déjà.
Part no. 88-4410-72 fits the old model as well.
Refund case #55120987 is still open after a month.
Not worth it. The Harper lamp from the market is better.
Only 14 of 20 screws were in the bag.
Very quiet, very light, very expensive.
Лампа светит ярко, но кнопка заедает.
音がとても静かで、電池も長持ちします。
屏幕很亮，电池一般。""".split("\n")


def held_out() -> list[tuple[str, list[tuple[int, int, str]]]]:
    out = []
    for line in MARKED:
        text, spans, at = "", [], 0
        for m in re.finditer(r"<([episn]):([^>]*)>", line):
            text += line[at : m.start()]
            value = m[2]
            skip = len(value) - len(re.sub(r"^(Mr|Mrs|Frau|Mme) ", "", value))
            spans.append((len(text) + skip, len(text) + len(value), KINDS[m[1]]))
            text += value
            at = m.end()
        out.append((text + line[at:], spans))
    return out
