"""The small labelled table that the personal-information model is trained on.

The table is written from general knowledge: common names of several countries and invented ones,
usual street words, the public forms of phone and identity numbers, and ordinary sentences of
customers.  Sentences are short patterns: ``(a|b)`` is a choice, ``{person}`` and the like stand for
a mention, ``{order}`` and the like for text that looks similar and is none.  ``labelled`` draws
choices, fillings, cases and slips from a seeded generator, so the table is the same every time; its
size is a parameter.
"""

from __future__ import annotations

import random
import re
import string

GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Anthony Betty Mark Sandra Steven Ashley Andrew Emily "
    "Kevin Donna Brian Michelle George Carol Edward Amanda Hans Klaus Stefan Andreas Monika Ursula Heike Anja Katrin Uwe Dieter Lukas Markus Birgit José María Juan Carmen Antonio Francisco Isabel Manuel Javier Lucía "
    "Pedro Pilar Luis Miguel Jean Pierre Jacques Michel Monique Nathalie Philippe Isabelle Sophie Julien Camille Chantal Lars Anders Ingrid Karin Sven Astrid Piotr Agnieszka Tomasz Marco Giulia Luca Paolo Elena Ahmed "
    "Fatima Omar Aisha Wei Yuki Hiroshi Priya Raj Olga Ivan Dmitri Natalia Tim Sue Bob Kate Tom Joe"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young King Wright Scott Green Adams Baker "
    "Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Murphy Kelly Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Neumann "
    "Zimmermann Krüger Hartmann Lehmann García López Sánchez Pérez Gómez Fernández Moreno Ruiz Díaz Romero Navarro Torres Dubois Durand Leroy Moreau Lefebvre Bertrand Roux Fournier Girard Lambert Hansen Olsen Larsen "
    "Nilsson Lindberg Nowak Kowalski Horvat Rossi Russo Bianchi Ferrari Kim Park Nguyen Tran Chen Wang Singh Patel Khan Ali Ivanov Petrov Popescu"
).split()
ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kr l m n p pl pr qu r s sch sh sk sl sn sp st sv t th tr v w wh y z".split()
VOWELS = "a e i o u a e i o ea ei ie oo ou au y".split()
CODAS = "b ck d f g k l ll m n nd ng nn nt p r rd rk rm rn rt s sk ss st t th x z".split()
NAME_ENDS = "son sen man mann berg burg stein feld er ert ez es ini etti elli ov ova ev ski sky wicz ic ak ko ton ham well worth ley by ford field wood shaw gard dahl lund qvist ström vik rup haus bach hof ing in et ard eau ier ois ell ard ia".split()
GIVEN_ENDS = "a o e i ia ina ella ette ine an en in on us is or ar ik el il y ie ine ata ora".split()
WORD_ENDS = "ing ed er es s ly y e ness tion able ful less al ic en ung heit lich ig es te st ado ida mente ción oso ar er ir ment eux ique ant té ée ois".split() + [""] * 6

STREETS = (
    "Main Park Oak Pine Maple Elm Washington Lake Walnut Spring Church Mill River Sunset Lincoln Franklin Jefferson Meadow Forest Highland Madison Chestnut Broadway Market Water Prospect Grant Center Union School Railroad "
    "Jackson Hickory Monroe Cherry Locust Adams Dogwood Liberty Valley Woodland Garden College Bridge Summit Clinton Harrison Delaware Virginia Colonial Canterbury Windsor Belmont Victoria Station King Queen Mountain Lakeview"
).split()
LAND = "Hill Hills Park Valley Woods Field Fields Point Bay View Heights Glen Run Falls Lake Meadows Bluff Shore Crossing Mill Brook Pond Station".split()
TYPES = "Street St Avenue Ave Road Rd Drive Dr Lane Ln Court Ct Place Pl Boulevard Blvd Circle Cir Highway Hwy Parkway Pkwy Terrace Ter Way Crescent Close Square Row Trail".split()
CITIES = "Springfield Riverside Franklin Greenville Bristol Clinton Fairview Salem Madison Georgetown Arlington Ashland Dover Oxford Jackson Burlington Manchester Milton Newport Auburn".split()
STATES = "CA NY TX FL IL OH PA MI GA NC WA OR".split()

THINGS = (
    "kettle|toaster|lamp|desk lamp|chair|office chair|backpack|suitcase|phone case|charger|keyboard|mouse|monitor|printer|speaker|radio|camera|tripod|drill|saw|hammer|ladder|hose|mower|grill|pan|pot|knife|blender|mixer|juicer|"
    "coffee machine|vacuum cleaner|iron|fan|heater|humidifier|scale|watch|alarm clock|tent|jacket|boots|gloves|bike|helmet|pump|ball|racket|doll|puzzle|board game|robot|train set|pillow|blanket|mattress|sofa|shelf|curtain|rug|mirror|toothbrush"
).split("|")
PARTS = "lid handle cable button screen battery zip strap wheel hinge motor filter switch plug cover base leg seam box manual knob lens lock spring hook label paint fabric colour sound finish".split()
WORDS = "good great bad nice cheap solid weak loud quiet broken sharp soft hard heavy light simple ugly pretty useful useless fine perfect terrible fast slow bright dark clean dirty stiff loose sturdy flimsy scratched cracked bent".split()
RELATIVES = "wife husband mother father mum dad sister brother son daughter aunt uncle cousin grandmother grandfather grandma grandpa neighbour neighbor colleague friend boss flatmate roommate landlord boyfriend girlfriend nephew".split()

#: Words that stand before a name and are none of it.
TITLES = "Mr. Mrs. Ms. Miss Dr. Prof. Mr Mrs Ms Sir Madam Herr Herrn Frau Señor Señora Sr. Sra. Don Doña M. Mme Mlle Monsieur Madame".split()

POSITIVE = """(Please|Kindly|You can|Just|) (write|e-mail|email|mail) (me|us|her|him|) (at|to|on|under|:) {email}(.|!| please.| if you (want|need) the {part}.| with (details|questions|photos).)|(My|Her|The|Our|Your) (email|e-mail|mail|contact|login|e-mail address|account) (is|was|:) {email}(.|, thanks.| and {email}.| or {email}.)
(Reply|Answers|Invoice|Receipt|Bill|Copies|Offers|Confirmation) (to|went to|sent to|goes to) {email}(.|, (please|not) {email}.|)|(cc|bcc|mail|e-mail|email|contact|from|to|reply-to)(:| |: ){email}|{email}|{email} (is my address|is mine|works best|never answers|bounced).|(They|Someone|The shop) (kept writing|wrote|sent spam) to {email}(.| and {email}.)
(Call|Ring|Phone|Text|Reach|Dial|Try) (me|us|him|her|them|) (at|on|under|) {phone}(.|!| after (five|six|work).| any (time|evening).| and ask for {person}.| please.| or {phone}.)|(My|Our|Her|His|The) (phone|number|mobile|cell|telephone|phone number|landline) (is|was|:) {phone}(.|, ask for {person}.|)|(tel|phone|mobile|cell|fax|call|ph|text|whatsapp)(.|:| |: |. ){phone}|{phone}|{phone} (is my number|, evenings only|works|after eight).
(You|They|The driver) (can|could|may|should) (reach|call|text|find) (me|us|her) (at|on|under) {phone} (most days|in the mornings|during the day|at night|).|(A man|Somebody|The agent|The seller) called (me|) from {phone}(.| twice.| about the {item}.)|(Contact|Signed|Sender|Customer|Name|Buyer|Recipient|Attn|From|To)(:|: | - ){person}(,|;| /| -|) {phone}|(Contact|Customer|Sender|Buyer)(:|: ){person}(,|;| /| -|) {email}(,|;| /| -|) {phone}
(My name is|I am|This is|It is|Here is|Yours,|Yours truly,|Sincerely,|Regards,|Best,|Kind regards,|Best wishes,|Cheers,|Love,|Thanks,|Thank you,|Signed,|-|--|—|–) {person}(.|)|(Thanks|Thank you|Many thanks|Kudos|A big thank you|Credit) to {person}(.|!| (from|in|at) (support|the shop|the counter|sales|service).| (who|for) (helped|helping) me.| who (repaired|replaced|fixed|explained) the {part}.)|{person} (from|in|at|of) (support|sales|service|the shop|the store|the call centre|reception|the warehouse) (was|is|seemed) (kind|rude|helpful|friendly|patient|great|slow)(.|, but the {part} is {word}.)
(I|We) (spoke|talked|chatted|met|dealt) (with|to) {person}(.| (twice|yesterday|on the phone).| about the {part}.)|(Ask|Look|Wait) for {titled}(.| (at|in) the (counter|shop|desk|office).)|(I|We) (told|asked|informed|called|phoned|emailed|wrote to|met|saw|thank|thanked) {titled}(.| (twice|again|yesterday|already).| about (it|the {part}).)|{titled} (called|answered|promised|told me|sold me|helped|wrote|apologised|refused|came|repaired it|sent it)(.| (twice|again|at once|in person).)|(The|Our|My) (agent|seller|manager|technician|courier|driver|plumber|teacher|doctor|lawyer), {person}, (promised|said|called|came|forgot|apologised)( to come|) (again|back|twice|).
(My|Our|Her|His) {relative} {person} (has|uses|bought|wants|likes|hates|recommended|gave me|says) (it|one|that {item}|the {item})(.| too.| as well.)|(My|Our) {relative} {person} ({phone}) (has|had|knows) (one|it|the seller).|(PS|P.S.|PS:|P.S.:|) {person} (says|sends) (hello|hi|thanks|greetings)(.|)|{person} (and|or) {person} (both|) (liked|used|bought|returned|complained about) (it|the {item}).|(Leave|Put|Drop) it (with|at) {person}( next door|, number {small}|).|(The|A) (parcel|package|box|letter) was (left|accepted|signed|taken) (by|with) {person}( at number {small}|).|(Warranty|Form|Receipt) (signed|completed|stamped) by {person} (on {date}|).|Should {person} (find|see|get) this(:|,) please (call|answer|use) {contact}.|{person} (told|asked|sold|gave|showed) (me|us) (this|it|one|the {item}).|bought (it|this|mine|one) (from|off) {person}(,| who (lives|works)) (at|in) {address}(.|; call {phone}.)
(I|We) (live|lived|moved|am staying|work) (at|to) {address}(.| now.| since {year}.| so (collection|delivery) is simple.)|(My|Our|The|New|Old|Her|His) (address|home address|new address|postal address|office|house|flat) (is|was|:|is now) {address}(.|, (thanks|please).)|(Send|Ship|Deliver|Forward|Return|Post|Mail) (it|this|the {item}|the {part}|everything|a new {part}) to {address}(.| please.|, not to {address}.)|(Send|Ship|Deliver|Post) (it|the {part}|the {item}|the refund|a new one) to {person}, {address}(.|)|(It|The parcel|The {item}|The package|My order) (was delivered|went|was sent|came|ended up|arrived) (to|at) {address}(.| by mistake.| instead.| again.)|{address}|{person}, {address}|{person}(;|,) {address}(;|,) (call|text|phone|tel.|ring|mobile|) {phone}|(Seen|Found|Sold|Bought|Picked up|Collected) (at|in) {address}(;|,|.) (call|text|phone|tel|ring|ask for {person},|mobile) {phone}(.|)|(Address|Ship to|Deliver to|Billing address|Home)(:|: ){address}|(The|Its) (label|envelope|sticker|note|parcel) (said|says|showed)(:|) (”|"|'|){person}, {address}(.|)|{address} (is|was) (the|my|our) (right|correct|old|new|wrong) (address|place|house)(.|)|(Collection|Pick-up|Viewing) at {address}, (ring|ask for|call) {person}.
(My|His|Her|The) (SSN|social security number|social security no.|social|national insurance number|NI number|insurance number|passport number|passport no.|passport|ID number|ID|identity number|identity card number|ID card number|driver's licence|driver's license number|driving licence number|licence number|license no.|tax ID) (is|was|:|,) {identity}(.|, (why|really)?|)|(SSN|NI no|Passport|ID|ID no.|Licence|License|DL)(:|: | |. ){identity}|(They|The form|The clerk|The shop|The site|A clerk) (asked for|wanted|needed|demanded|printed|showed|published|copied|read out) my (SSN|social security number|passport number|ID number|insurance number|licence number|driver's licence|national ID), {identity}(,|) (on the (label|form|box|parcel)|for a {item}|why|as well|).|(On|In) the (form|letter|label|file) (was|were|stood) my (passport number|ID number|SSN|insurance number) {identity}(.| and my (old|home|new) address {address}.)|(Name|Customer)(:|: ){person}(,|;) (SSN|passport|ID|DOB {date}, ID) {identity}(.|, {order}.)|(licence|passport|insurance|ID) (number|no.|no) {identity} (was needed|was required|is mine|on file|for the age check).
(Schreiben Sie|Schreibt|Bitte|E-Mail|Mail|Kontakt|Antwort) (mir|uns|bitte|) (an|unter|:) {email}(.|!)|(Meine|Unsere) (E-Mail|Mail|Mailadresse|E-Mail-Adresse) (ist|lautet|war|:) {email}.|(Rufen Sie|Ruft|Bitte) (mich|uns|) (unter|an unter|zurück:|an:) {phone}(.| an.| zurück.)|(Meine|Die) (Nummer|Telefonnummer|Handynummer) (ist|lautet|:) {phone}.|(Tel|Telefon|Handy|Mobil|Fax)(.|:|: | ){phone}|(Ich bin|Wir sind) (tagsüber|abends|morgens|meist) (unter|auf) {phone} (zu erreichen|erreichbar).|(Herr|Frau|Herrn|Dr.) {person} (hat|war|rief|kam|wollte|versprach|schrieb) (mir geholfen|sehr nett|mich an|an|zu spät|einen Ersatz|nicht).|(Danke|Vielen Dank|Dank) an (Herrn|Frau|) {person}(.|!| (vom|aus dem) (Service|Kundendienst|Laden).)|{person} (vom|aus dem) (Service|Kundendienst|Laden|Verkauf|Lager) (war|ist) (nett|freundlich|unfreundlich|hilfsbereit).|(Viele|Liebe|Beste|Freundliche|Mit freundlichen) (Grüße|Grüßen)(,|) {person}|(Gez.|Ihr|Ihre|Euer|MfG|LG) {person}|(Mein|Meine|Unser) (Nachbar|Bruder|Schwester|Freundin|Kollege|Mann|Frau|Mutter) {person} (hat|nutzt|will|kaufte) (auch|) (so|) (einen|eins|das Gleiche).|(Ich wohne|Wir wohnen) (jetzt|) in der {adresse}(.)|(Bitte|) (Senden|Schicken|Liefern) Sie (es|das Paket|den Ersatz|die Ware) an {person}, {adresse}.|(Lieferung|Paket|Ersatz|Sendung) (ging|kam|bitte|liegt) (an|in|bei|nach)(:|) {adresse}.|(Anschrift|Adresse)(:|: ){adresse}|{person}, {adresse}|(Meine|Die|Seine) (Ausweisnummer|Personalausweisnummer|Passnummer|Reisepassnummer|Sozialversicherungsnummer|Steuer-ID|Führerscheinnummer) (ist|lautet|war|:|) {ausweis}(.| stand auf dem (Paket|Brief|Formular).)|(Ausweis|Personalausweis|Pass|Ausweis-Nr.)(:|: | ){ausweis}
(Escríbame|Escríbanme|Mándame un correo|Mi correo|Mi correo es|Correo|Contacto)(:|) (a|al|) {email}.|(Mi|El) (teléfono|móvil|número|número de teléfono) (es|:) (el|) {phone}.|(Llámame|Llámenme|Llame|Llamen|Telefonee) (al|a) {phone}(.| por la tarde.| y pregunte por {person}.)|(Tel|Teléfono|Móvil)(.|:|: | ){phone}|(El señor|La señora|Don|Doña|El Sr.|La Sra.) {person} (me ayudó|fue amable|no contestó|me llamó|prometió venir|es muy simpática).|(Gracias|Muchas gracias) a {person}(.| (de|por) (la tienda|su ayuda|todo).)|{person} (de|del) (la tienda|servicio|almacén|soporte) (fue|es|era) (amable|antipático|rápida).|(Saludos|Un abrazo|Atentamente|Cordialmente)(,|) {person}|(Mi|Nuestra) (hermana|vecino|madre|amigo|mujer|marido) {person} (tiene|compró) uno igual.|(Vivo|Vivimos) en (la|) {direccion}.|(Envíen|Envíe|Manden|Entregar) (el paquete|todo|la pieza|el recambio|) (a|en) {direccion}.|(Envíen|Mandar|Enviar) (el recambio|todo|) a {person}, {direccion}.|(Dirección|Domicilio)(:|: ){direccion}|(Mi|El|Su) (DNI|NIE|número de DNI|pasaporte|número de identidad|carné de identidad) (es|:|era|,|) (el|) {dni}(.| aparecía en (el paquete|la caja|el recibo).)|(DNI|NIE|NIF)(:|: | ){dni}
(Écrivez-moi|Merci d'écrire|Contactez-moi|Mon adresse mail est|Mon mail|Mail|Contact)(:|) (à|) {email}.|(Appelez-moi|Rappelez-moi|Joignez-moi|Téléphonez|Je suis disponible) au {phone}(.| le matin.| et demandez {person}.)|(Mon|Le) (numéro|téléphone|portable|numéro de téléphone) (est|:) (le|) {phone}.|(Tél|Tel|Port|Portable)(.|:|: | ){phone}|(M.|Mme|Mlle|Monsieur|Madame) {person} (m'a aidé|m'a appelé|a été très gentille|n'a pas répondu|est venu|a promis un échange).|(Merci|Un grand merci) à {person}(.| (du|pour) (magasin|service|l'aide).)|{person} (du|de la) (service|magasin|boutique|standard) (était|est|a été) (aimable|désagréable|rapide).|(Bien à vous|Amicalement|Salutations|Sincèrement|Bises)(,|) {person}|(Ma|Mon|Notre) (sœur|voisin|mère|ami|mari|femme) {person} (a|veut|utilise) (le même|un autre).|(J'habite|Nous habitons) (au|) {rue}.|(Envoyez|Livrez|Expédiez|Adressez) (le colis|la pièce|tout|) (au|à) {rue}.|(Envoyer|Livrer) (le colis|) à {person}, {rue}.|(Adresse|Livraison)(:| : ){rue}|(Mon|Ma|Le) (numéro de carte d'identité|carte d'identité|numéro de sécurité sociale|passeport|numéro de passeport) (est|:|était|) (le|) {carte}(.| figurait sur le (formulaire|paquet|bon).)
(Пишите|Напишите|Моя почта|Почта)(:| мне| на|) {email}.|(Звоните|Мой номер|Телефон|Мой телефон|Тел.)(:| по| |) {phone}.|(Спасибо|Благодарю) {cyrillic} (за помощь|из магазина).|С уважением, {cyrillic}|(メール|連絡先|お問い合わせ)(は|:|：){email}(です|まで)。|(電話|電話番号|携帯)(は|:|：){phone}(です|まで)。|(邮箱|电子邮件|请发邮件到|联系方式)(：|:|是|){email}。|(电话|手机|我的电话|请打)(：|:|是|){phone}(。|，谢谢。)|(البريد|بريدي|راسلني على|اكتبوا إلى) {email}.|(هاتفي|رقمي|اتصل على|الهاتف) {phone}.
(Saludos|Un saludo|Un cordial saludo|Besos|Gracias|Atte.)(,|.|) {person}|(Llamen|Llamad|Llama|Pregunten|Pregunte|Escriban|Avisen) (a|por) {person}( al {phone}|)(.|)|(Gruß|Grüße|Schöne Grüße|Liebe Grüße|Danke)(,|) {person}|(Bitte|) (nach|für|an) {person} (fragen|abgeben|senden|klingeln)(.|, {adresse}.|)|(Merci|Bien cordialement|Respectueusement|À bientôt)(,|) {person}|(Demandez|Appelez|Contactez|Prévenez) {person}( au {phone}|)(.|)|(Apuntaron|Copiaron|Pidieron|Mostraron|Imprimieron) mi (DNI|NIE|pasaporte|número de DNI)(,|) {dni}(.| en (la|el) (factura|recibo|sobre).)|(Notiert|Kopiert|Gefragt|Gedruckt) wurde (meine|die) (Ausweisnummer|Passnummer) {ausweis}.|(Ils ont|Le livreur a|On a) (noté|copié|affiché|demandé) (mon|ma) (carte d'identité|numéro de passeport|numéro de carte)(,|) {carte}.
(Sincerely|Regards|Best regards|Warmly|Thanks again|Greetings|Take care|Bye|Yours)(,|) {person}|(--|—|–|-|~) {person}(.|)|(Courier|Neighbour|Technician|Clerk|Assistant|Colleague|Friend) {person} (came|was|called|helped|fixed it|left|waited|sold it)(.| (again|quickly|late|today).)|(ring|knock|call|ask) (at|for) {person}(.|)|(Written|Checked|Packed|Sent|Ordered|Received|Reviewed|Posted) by {person}( on {date}|)(.|)|(The (card|note|parcel|sticker) (was for|names|mentions)|It was meant for) {person}(.|, {address}.|)|{email}(, (then|also|later|another|a new one) {email}|, {email}| / {email}| or {email})(.|)|(Name|Contact|Seller)(:|: ){person} / {email}( / {phone}|)"""

NEGATIVE = """(I|We|My {relative}|The {relative}|Everyone|Nobody) (bought|ordered|got|returned|tried|wanted|recommended|opened|dropped|kept|lost) (a|the|this|another|one more) {item}(.|!| (last|this|every) (week|month|year|spring|summer|autumn|winter).| for the (garden|garage|kitchen|office|bedroom|trip|holidays|children|cat).| on {date}.| for {price}.| and it is {word}.)|(It|This|The {item}|The {part}|Mine|Ours) (is|was|looks|feels|seems|sounds|stays|turned out|became) (very|really|too|rather|so|a bit|quite|surprisingly|not|still|already|) {word}(.|!|, (but|and|though|while) the {part} is {word}.| (after|since|for) (a|one|two|three) (day|days|week|weeks|month|months|wash|washes).)
The {part} (broke|bent|fell off|came loose|stopped|leaks|rattles|squeaks|sticks|clicks|jams|works|fits|shines|peels|faded|snapped)(.| (on|after|within) (the first day|a week|{small} days|a month|the second use).| (again|twice|at once|soon).)|(Very|Really|So|Too|Quite|Rather|Not|Just|Simply|) {word}(.|!|)|{word}, {word}(.| and {word}.|, nothing else.)|(Would|Will|Can|Could) (not|) (buy|recommend|order) (it|this|again|another)(.|!| to (anyone|friends|nobody).)|(Great|Good|Bad|Poor|Fair|Top|Awful) (value|quality|price|service|product|purchase|seller|{item}|{part})(.|!|, (great|good|bad|poor) (price|service|seller|colour).)|(Thanks|Thank you|Cheers|Sorry|Hello|Hi|Hey|Dear all|Hello everybody|Good morning)(.|!|, | )(for (reading|nothing|the quick delivery)|to all|everyone|again|)(.|!)
(Order|My order|The order|Order number|Order no.|Purchase|Invoice|Ticket|Case|Return|Refund|Claim|Reference|RMA) (is|was|number|:|no.|) {order}(.| (was|is) (late|lost|closed|open|cancelled|refunded).)|(Serial|Serial number|Model|Part|Item|Article|Product|Batch|SKU|EAN|Barcode|Tracking|Parcel) (number|no.|is|:|) {serial}(.| (is|was) (printed|written|stamped) on the (box|back|label|lid).)|(On|Under) the (box|label|back|bottom) (it says|is written|you find|stands) {serial}.|(Tracking|Shipment|Parcel) {serial} (moved|was updated|arrived|was lost|got stuck)(.| {small} times.)|(Paid|Cost|Costs|It cost|I paid|Only|For|Just) {price}(.|, (which is|that is) (fair|too much|a bargain).| and (it|the {part}) is {word}.)|(Version|Firmware|Release|Update) {version} (fixed|broke|changed|helped|works)( it| nothing| the {part}|).
(In|Since|From|Back in|By) {year} (I|we|they) (had|bought|used|saw|made) (one|an older {item}|the first {item}).|(Bought|Updated|Edited|Update|Edit|Ordered|Delivered|Arrived|Received) (on|:|) {date}(.|: the {part} is {word}.| and used (daily|weekly|in the kitchen).)|{date}|(About|Around|Nearly|Only|After|Within) {small} (minutes|hours|days|weeks|times|pieces|screws|stars|watts|cm|mm|inches|pounds|people|e-mails|calls|points)(.| (missing|later|in total|of ten).)|{small} (of|out of|from) (5|10|ten) (stars|points|)(.|)|(Size|Length|Width|Weight|Height|Capacity)(:|: | is | ){small}(.| cm.| kg.| mm.| litres.)|It (needs|uses|draws|holds|weighs) (about|) {small} (watts|litres|kilos|batteries|cups).|(See|Visit|Look at|Go to|More on|Instructions at) (www.example.com|www.example.org|example.com|https://example.org)/(help|shop|manual|video|faq)(/{small}|) (for|about) the {part}.|(Follow|Ask|Write to|See|Thanks) @(support|shop|service|brand|store|help)(team|desk|online|) (on|in) (chat|the app|social media).
(My|Our|The|Her|His) {relative} (laughed|smiled|complained|loves it|hates it|uses it daily|scraped a knee|asked for one|wants another|is happy|gave it back|found it {word})(.| (yesterday|again|at once).)|(Gift|Present|Bought it) for my {relative}(.|, who (loves|hates|returned) it.)|(A|One|Every) (friend|guest|visitor|child|customer|colleague) (asked|noticed|said|thought) (it|the {part}|this) (was|is) {word}.|(Even|Only) (the|my|our) (dog|cat|{relative}|children|kids) (can|could|will|would) (use|open|break|like) (it|this).|(I am|I'm) {small} (years old|) and (do not|don't) (care|mind|need) (about|for|) (the {part}|colour|looks).|(No|Any|Some) (smell|noise|scratch|dent|problem|trouble|complaint|instructions|screws)(.|!| (so far|at all|yet|until now).)
(We|I) (drove|went|flew|walked|travelled) (to|from|through) (the sea|London|Paris|Berlin|Spain|the mountains|Lake Tahoe|New York) (with|for) (it|the {item}|a week)(.|!)|(The|This) (shop|store|warehouse|factory|company|brand|seller|website) (in|from|near|off) (Hamburg|Lyon|Madrid|Boston|China|the town|Leeds) (is|was|ships|answers|sells) (slowly|quickly|{word}|well|late).|(On|Every|Last|Next) (Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|March|April|May|June|August|October|December|Christmas|Easter) (it|the {item}|the parcel) (came|broke|arrived|worked|went back).|(Conclusion|Summary|Pros|Cons|Verdict|Note|Tip|Warning|PS|Update|Edit|Bottom line|In short|Overall|Finally)(:|,) (it is|the {part} is|) {word}.|(Why|How|What|When|Where|Who) (does|did|is|would|can) (it|the {part}|anyone|nobody) (break|stick|do this|need|say)(?|!)|{brand} (is|was|makes|sells|should|used to be) (a|an|the|) (good|bad|{word}) (brand|company|maker|name|{item}).|(The|My|Our|A|This) {brand} (beats|replaced|outlives|is better than|is worse than) (the|my|any|our) (old|other|) {brand}.|(Ordered|Bought|Tried) (from|by|the|) {brand}(.| (twice|before|online).| and {brand}.)
(It|The {item}|This thing) (stands|sits|hangs|lies|stays|lives) (in|on|under|by) the (hall|hallway|cellar|attic|porch|balcony|shed|car|desk|shelf|corner|bathroom)(.|, where it (looks|is) {word}.| (unused|all day|since {year}).)|(Fast|Quick|Slow|Late|Free) (delivery|shipping|postage|dispatch)(.|!|, (good|bad|poor|nice) (packaging|packing|box).)|(Happy|Sad|Angry|Pleased|Disappointed|Satisfied|Delighted|Annoyed) (customer|buyer|so far|with it|every day|)(.|!|)|(Recommended|Highly recommended|Avoid|Never again|Love it|Hate it|Do not buy|Buy it|Five stars|One star|Perfect|Wow|Ok|Okay|Meh|Works|Broken|Useless|Amazing|Superb)(.|!|!!|)|(I|We) (got|received|was given|were sent) (this|the|a) {item} (free|at a discount|for testing|in return for a review)(.| and (I|we) (like|love) it.)|(Use|With) (the|) code (DEAL|SUN|BONUS){small} (you get|for|and get) {small} % off.|(Best|Worst|Nicest|Finest) {item} (ever|of all|in years|I know|on the market)(.|!)|(Could be|May be|Might be|Should be|Used to be|Has to be) {word}(.|, (could be|may be|might be) {word}.|, (impossible|too early) to (judge|say).)
(Der|Die|Das|Mein|Meine|Ein|Eine|Dieser|Unser|Kein) (Deckel|Griff|Motor|Akku|Stoff|Rahmen|Schalter|Bildschirm|Lautsprecher|Wasserkocher|Toaster|Rucksack|Staubsauger|Koffer|Lampe|Pfanne|Kamera|Bohrmaschine|Matratze|Leiter|Verpackung|Anleitung|Lieferung|Farbe|Qualität|Preis|Händler|Artikel|Gerät|Kabel|Knopf|Henkel|Bezug|Reißverschluss|Filter|Karton|Kundendienst|Verkäufer|Nachbar|Hund|Ware) (ist|war|wirkt|bleibt|wurde|klemmt|quietscht|hält|passt|riecht|läuft|kam|fehlt|antwortet) (sehr|leider|schon|noch|nicht|zu|immer|gut|) (gut|schlecht|laut|leise|stabil|billig|schwer|locker|kaputt|schön|defekt|praktisch|wackelig|super|perfekt|spät|schnell)(.|!|, aber (der|die|das) (Preis|Farbe|Material) (stimmt|passt|gefällt).| nach (einer Woche|zwei Tagen|einem Monat|dem Waschen).)|(Ich|Wir|Man) (habe|haben|hatte|kaufte|kauften|suche|nutze|bin|sind|war|kann|will) (ihn|sie|es|das Gerät|den Artikel|dieses Produkt|zufrieden|begeistert|enttäuscht|lange|seit {year}) (gekauft|bestellt|zurückgeschickt|benutzt|empfehlen|täglich|gesucht|nicht|sehr)(.|!)|(Gute|Schlechte|Schnelle|Tolle|Klare|Keine|Beste|Top) (Qualität|Lieferung|Verarbeitung|Empfehlung|Ware|Kaufempfehlung|Idee)(.|!)|(Bestellung|Bestellnummer|Auftrag|Rechnung|Rücksendung|Artikel|Artikelnummer|Seriennummer|Modell|Vorgang) (war|ist|Nr.|:|) {order}(.|)|(Seriennummer|Artikel|Charge|Modell|Sendung|Typ)(:|: | |. ){serial}|(Für|Nur|Kostet|Preis) {price}(.| (ist das|war es) (fair|zu teuer|günstig|ok).)|(Nach|Seit|Vor|In) {small} (Tagen|Wochen|Minuten|Stunden|Jahren|Monaten) (defekt|kaputt|aufgebaut|fertig|zufrieden).|(Gekauft|Nachtrag|Update|Stand|Geliefert)(:| am| vom) {date}(.|: (alles gut|immer noch gut|leider defekt).)|(Hallo|Guten Tag|Liebe Leute|Moin|Servus)(,|!|) (der|die|das) (Griff|Ware|Gerät) (ist|war) (gut|da|kaputt).|(Fazit|Kurz|Insgesamt|Achtung|Tipp|Übrigens)(:|,) (nicht kaufen|gerne wieder|alles bestens|sehr gut|nie wieder|klare Empfehlung)(.|!)|(Meine|Unsere|Die) (Frau|Kinder|Mutter|Katze|Tochter|Freundin|Kollegen|Nachbarn) (will|wollen|mag|mögen|findet|finden|lacht|lachen) (es|ihn|auch einen|das Gerät)(.| (sehr|gut|jetzt|auch)).
(El|La|Este|Esta|Un|Una|Mi|Nuestra) (mango|tapa|motor|batería|pantalla|cable|funda|caja|color|precio|calidad|lámpara|mochila|silla|olla|cámara|maleta|tostadora|manta|envío|vendedor|vecino|gato|botón|rueda|tela|costura|producto|aparato) (es|era|está|parece|llegó|queda|funciona|resultó|huele|suena) (muy|bastante|demasiado|poco|más|ya|) (bueno|malo|bonita|feo|roto|ruidoso|suave|caro|barato|bien|mal|tarde|pesado|ligera|perfecto|débil)(.|!|, (pero|y) (el precio|la calidad) (es|está) (bueno|bien|mal).| (desde|tras|en) (ayer|una semana|dos meses).)|(Lo|La|Me|Nos|No|Ya) (compré|compramos|devolví|recomiendo|gusta|encanta|uso|funciona|llegó|quiero) (mucho|otra vez|para la cocina|para mi {pariente}|en la oficina|cada día|nunca más)(.|!)|(Buena|Mala|Excelente|Pésima|Muy buena) (calidad|compra|relación|atención|idea|marca)(.|!)|(Pedido|Mi pedido|Número de pedido|Devolución|Factura|Referencia) (es|era|:|n.º|) {order}(.|)|(Serie|Modelo|Lote|Artículo|Número de serie|Código)(:|: | ){serial}|(Por|Cuesta|Pagué|Vale) {price}(.| (está bien|es mucho|es barato)).|(Comprado|Actualización|Actualizado|Recibido)(:| el) {date}(.|: (todo bien|sigue bien|ya no va).)|(Después de|Tras|En|Hace) {small} (días|semanas|minutos|horas|meses) (se rompió|sigue igual|montado|todo bien).|(Hola|Buenas|Buenos días|En resumen|Conclusión|Ojo)(,|:|) (no compren|muy contenta|todo bien|lo mejor|nada más)(.|!)|(Mi|Nuestro) {pariente} (quiere|usa|tiene|compró|rompió) (otro|uno igual|el mismo)(.| también.)
(Le|La|Ce|Cette|Un|Une|Mon|Notre|L'article, le) (couvercle|poignée|moteur|batterie|écran|câble|housse|boîte|couleur|prix|qualité|lampe|sac|chaise|casserole|appareil|valise|tissu|bouton|roue|livraison|vendeur|voisin|chat|produit|notice|couture|filtre|cadre) (est|était|semble|reste|arrive|fonctionne|sent|sonne|tient|paraît) (très|trop|assez|un peu|plutôt|déjà|bien|) (bon|mauvais|jolie|laid|cassé|bruyant|doux|cher|solide|fragile|lourd|légère|parfait|tard|tordu|rayé)(.|!|, (mais|et) (le prix|la qualité) est (bon|bonne|correct).| (depuis|après|dès) (le premier jour|une semaine|deux mois).)|(Je|J'ai|Nous|On|Nous avons) (recommande|acheté|rendu|utilise|cherchais|aime|reçu|déçu|testé|attends) (ce produit|cet appareil|le même|beaucoup|encore|pour la cuisine|pour ma {parente}|chaque jour|depuis {year})(.|!)|(Bonne|Mauvaise|Excellente|Belle) (qualité|affaire|idée|surprise|marque|livraison)(.|!)|(Commande|Ma commande|Numéro de commande|Retour|Facture|Référence)( :| n°|:|) {order}(.|)|(Série|Modèle|Lot|Article|Numéro de série|Code)( :|:|) {serial}|(Pour|Coûte|Payé|Vaut) {price}(.|, (c'est|c'était) (correct|trop cher|donné).)|(Acheté|Mis à jour|Reçu|Édité)(:| le) {date}(.| : (tout va bien|rien à dire|en panne).)|(Après|Depuis|En|Pendant) {small} (jours|semaines|minutes|heures|mois)(,|) (cassé|toujours bien|monté|en panne).|(Bonjour|Salut|En bref|Conclusion|Attention|Voilà|Dommage|Hélas)(,| :|) (à éviter|très contente|tout va bien|rien à dire|plus jamais|je recommande)(.|!)|(Ma|Notre) {parente} (veut|utilise|a acheté|a cassé) (le même|un autre|celui-ci)(.| aussi.)
(Это|Очень|Купил|Купила|Заказ|Мой|Наша|Крышка|Ручка|Кнопка|Товар|Цена|Мотор|Чайник|Лампа|Стул|Сумка|Камера) (хороший|плохая|купил|сломался|работает|пришёл|нравится|отличный|тихая|дорого|красивая|удобный|прочная|шумит|{item}) (товар|выбор|чайник|и удобный|через неделю|уже месяц|всем|но дорого|с первого дня|на кухне|для дома|)(.|!)|(Заказ|Номер заказа|Возврат|Серия|Модель|Артикул|Заявка)(:| №|) {order}(.|)|(Рекомендую|Советую|Не советую|Не покупайте|Спасибо|Привет|Здравствуйте|Супер|Итог|Кратко|Отлично|Ужасно)(.|!|, всё работает.|: хороший товар.)|(За|Цена|Стоит) {price}(.| это дорого.| нормально.)|(Куплено|Обновлено|Получено)(:|) {date}.|(Моя сестра|Сосед|Мама|Дети|Коллега) (тоже хочет|смеётся|пользуется|довольна)(.|!)
(とても|すごく|少し|やや|かなり|)(良い|静か|重い|便利|丈夫|残念|きれい|うるさい|高い|軽い)(です|でした|商品です|買い物でした)。|(蓋|取っ手|電池|画面|音|色|箱|モーター|説明書|生地|値段)(が|は)(壊れました|良いです|弱いです|すぐ取れました|問題ありません|きれいです|高いです)。|(注文番号|注文|型番|品番|製造番号|返品番号)(は|：|:){order}(です|)。|{price}(で買いました|は高いです|の価値はあります)。|{date}(に届きました|に購入しました|追記)。|(家族|母|友人|同僚|息子|妻)(も|が)(使っています|喜んでいます|欲しがっています|笑いました)。|(おすすめ|満足|不満|最高|最悪|以上|こんにちは)(です|)。|(很|非常|有点|太|不太|真的)(好|安静|重|方便|结实|失望|漂亮|吵|贵|轻)(，推荐|，不推荐|，值得|了)。|(盖子|手柄|电池|屏幕|声音|颜色|包装|电机|说明书|布料|价格)(很好|坏了|不错|太差|有问题|掉了|很漂亮)。|(订单号|订单|型号|编号|批号|退货单)(是|：|){order}。|(花了|价格|只要|卖){price}(，不贵|，太贵了|)。|{date}(收到|购买|更新)(，一切正常|，坏了|)。|(家人|妈妈|朋友|同事|孩子)(也很喜欢|也想买|说不错|笑了)。|(推荐|满意|不满意|完美|大家好|总的来说)(，|。)
(المنتج|الجهاز|الغطاء|المقبض|البطارية|اللون|السعر|المحرك|الصوت|الشاشة|التوصيل) (جيد|سيئ|ممتاز|ضعيف|هادئ|جميل|مكسور|ثقيل|سريع|متأخر)(.| جدا.| ولكن غال.| بعد أسبوع.)|(رقم الطلب|الطلب|الرقم التسلسلي|الموديل|الفاتورة)(:|) {order}.|(اشتريته|وصل|تحديث)( في|:|) {date}.|(السعر|دفعت|ثمنه) {price}(.| وهو غال.| وهو مناسب.)|(أمي|أختي|الجار|صديقي|الأطفال) (يحبه|يريد واحدا|ضحك|أعجبه)(.|!)|(أنصح به|لا أنصح به|شكرا|مرحبا|ممتاز|باختصار)(.|!|، جيد.)
(It is|This is|That is|Here is|I have|We have|I own|Mine is|I wanted|They sell) (a|an|the|my|our|another) (second|third|first|last|new|old|) {item}(.|, (nothing|no) (else|less).| and it is {word}.| (with|without) a (new|{word}) {part}.)|(I|We) (got|ordered|own) (a|my|our) (second|third|fourth|next|new) {item} (for|from) (a|my|the|our) (office|{relative}|car|garden).|(Great|Nice|Bad|Lovely|Awful|Poor) {item}(.|!|)|(Model|Type|Product|Modell|Modelo|Modèle|Marke|Marca|Marque|Typ|Producto|Produit|Artikel)( |: ){item}(.|, (version|Version|versión|rev.|v|ver.) {version}.|)|(Compared|Measured) (to|against) (my|the) (old|other) {item}(,| from {year},) (this|it|the {part}) is {word}.
(One|Two|Four|Six|Several|Most|Both|None|All|Some) of (my|our|its|these|the) ({small} |)(buttons|legs|pages|seams|bulbs|wheels|lids|bolts) (is|was|were|are|came) {word}(.| (on|since) day one.)|(There|Here) (are|were) {small} (buttons|levels|speeds|pages|bolts)(.| in the box.)|(Es fehlen|Es gibt|Hat|Mit|Trotz) {small} (Teile|Knöpfe|Seiten|Grad|Programme|Rollen|Dübel)(.|n.)|(Hay|Trae|Faltan|Con|Lleva) {small} (piezas|botones|páginas|ruedas|grados|luces)(.|)|(Il y a|Avec|Il manque|Il reste|On compte) {small} (pièces|boutons|pages|roues|degrés|crans)(.|)|(С|Есть|Всего|Через) {small} (минут|кнопок|дней|раз|деталей).|{small}(分で組み立て|個足りません|段階あります|分钟装好|个零件|天后坏了)。
(It|This|The {item}|The {part}) (is|was|looks) (easy|hard|ready|slow|quick|safe) to (use|wash|open|carry|move|fold|store)(.|, (no|not|and|but|with|especially|mostly|even|well) (noise|smell|heavy|cheap|the {part}|{word})(.|, {word}.))|(Well|Badly|Nicely|Poorly|Neatly) (made|built|packed|sewn|glued|finished)(, {word}|)(.|, (no|some) (gaps|stains|noise).)|(es|está|queda|viene|resulta) (fácil|difícil|cómodo|imposible) de (usar|lavar|montar|abrir|doblar|guardar|limpiar)(.|, (muy|poco) práctico.)|(c'est|il est|elle reste|facile,|reste) (facile|difficile|agréable|impossible) à (utiliser|laver|monter|ouvrir|ranger|plier|nettoyer)(.|, (très|peu) pratique.)|(leicht|einfach|schwer|kaum|gut) zu (bedienen|waschen|öffnen|tragen|falten|reinigen)(.|, (aber|und) (laut|teuer|stabil).)|(Auf|In|Mit|Bei|Nach|Unter|Ohne|Trotz) (der|dem|den|einer|einem|ganzer|voller) (Karton|Linie|Waage|Küche|Werkstatt|Terrasse|Rückseite|Arbeit|Reise|Kraft|Reinigung)(,|) (klare|klar|leider|steht|liegt|hält|fehlt|läuft) (nichts|alles|Sache|gut|es|Empfehlung|gar nichts)(.|!)
(Tiny|Small|Big|Huge|Long|Short|Wide|Thick|Thin|Hot|Cold|Warm|Wet|Dry|Sweet|Sour|Round|Square) {part}(.|!|, {word}.|)|(Every|Each|No|This|That|Another|Any|Half|Last|Next) (morning|night|time|day|week|summer|winter|spring|try|part|friend|visit) (it|the {part}|the {item}|something) (works|broke|sticks|helps|fails|is {word})(.|!)|(Worth|Worse|Better|Less|More|Nothing|Something|Everything|Anything|Nobody|Somebody) (than|like|about|for|of|with|but) (it|that|the (money|price|old one|{part})|{price})(.|!)|(They|You|One|It|We|Someone) (say|says|notice|see|hear|want|know|feel|need|promise|asked|laughed|broke) (it|the {part}|that|nothing|this|at once|at the {part})(.|, (but|so|as|because) (it|the {part}) (is|was|looks) {word}.)|(The|My|Our|A) ({relative}|dog|cat|courier|postman|baker|plumber|kids|seller|shop) (asked|said|wondered|laughed|saw|noticed|knows|cut|broke) (where|why|how|what|that|it|at|one) (it|the {part}|the {item}|I got it|they found it|happened)(.| (is|was) {word}.)
(Bonjour|Salut|Bonsoir|Coucou) (à tous|à toutes|tout le monde|les amis|à vous)(,|.|!) (le|la|ma|mon) (couvercle|commande|lampe|sac) (est|reste) (bien|bonne|cassée|là)(.|)|(Hola|Buenas|Saludos) (a todos|a todas|gente|amigos)(,|.|!) (la|el|mi) (tapa|silla|pedido) (es|está) (bien|buena|rota)(.|)|(Hallo|Guten Abend|Grüße) (zusammen|an alle|Leute|allerseits)(,|.|!) (der|die|das) (Lampe|Deckel|Gerät) (ist|war) (gut|da|kaputt)(.|)|(Всем|Привет всем|Добрый день)(,|!) (крышка|лампа|ручка) (хорошая|сломалась)(.|)|(Ravi|Déçu|Déçue|Contente|Parfait|Nul|Génial|Correct|Genial|Decepcionado|Contenta|Perfecto|Regular|Enttäuscht|Zufrieden|Begeistert|Prima|Klasse|Schrott|Доволен|Довольна|Хорошо|Плохо|Lovely|Brilliant|Rubbish|Excellent|Sturdy|Quiet|Cheap)(.|!|)
(En|Sobre|Bajo|Dentro de) la (etiqueta|base|bolsa) (dice|se lee|viene|aparece|pone) {serial}(.|)|(Sur|Sous|Dans) (l'étiquette|la base|le dos|la boîte|le carton)( :| on lit| il y a| est écrit) {serial}(.|)|(На|Под|Внутри) (этикетке|крышке|дне) (указано|стоит|напечатано|написано) {serial}.|(Auf|Unter|Hinten auf) dem (Etikett|Boden|Gehäuse) (steht|liest man|klebt) {serial}(.|)|(箱|ラベル|裏)には{serial}と(あります|書いてある)。|(盒子|标签|背面)(上|)(写着|是){serial}。|(على العلبة|على الغطاء) (مكتوب|الرقم) {serial}.|(Compare|Pair|Use|Replace|Combine) it with (a|the|my) {item}(.|)|(Forget|Skip|Try|Get|Take|Avoid) (the|a|any|your) {item}(.|!|)|(Send|Sent|Take|Took|Brought) (it|mine|the {item}) back( under {order}| with {order}|)(.|, (no answer|no refund|still nothing) (yet|so far|).)|(Devuelto|Reclamado|Tramitado|Enviado) con (el número|) {order}.|(Renvoyé|Réclamé|Expédié) sous {order}(.|)|(Zurück|Reklamiert|Verschickt) unter {order}(.|)|(Отправил|Сдал|Оформил) (под номером|как|по) {order}.|(You|We|They|I|He|She) (should|could|must|can|may|will|would|might) (not|never|always|still|just|) (use|clean|buy|try|wash|trust|keep|open) (it|this|the {part}|one)(.| (with care|at home|daily|again|outside|in water).)
(Los|Las|El|La|Un|Una|Mi|Mis|Sus|Nuestros|Unos|Todas las|Cada|Otro) (niños|niñas|hijos|padres|abuela|abuelo|mujer|marido|vecinos|amigos|compañeros|clientes|gente|familia|tapa|tela|noche|mañana|semana|instrucciones|tornillos|colores|botones|ruedas) (quieren|usan|ríen|preguntan|está|es|son|se|sigue|va|dice|piden|rompió|funciona) (todo|nada|mucho|otra|uno|bien|mal|feliz|lejos|contentos|rotos|aquí|así|mejor|igual|de nuevo)(.|!| {small} veces.)|(Al|Del|En el|En la|Para la|Por la|Sobre el|Con el|Desde la|Hasta el|Tras el) (final|principio|cabo|lado|mes|año|oficina|cocina|playa|casa|noche|fin|verano|invierno|viaje|trabajo|jardín|garaje|uso|lavado) (de|del|y|se|no|ya|sigue|está|hay|todo) (la semana|un mes|dos años|rompió|igual|funciona|nada|bien|ruido|va bien|la caja)(.|!|, {word}.)|(Ya|Pues|Así|Luego|Antes|Ahora|Siempre|Nunca|Además|También|Aunque|Porque|Como|Cuando|Según|Solo|Menos mal que) (el|la|lo|me|se|no|es|fue|está|va) (todo|bueno|motor|gusta|uso|rompe|mejor|peor|roto|tapa|veo|nota)(.|!|, gracias.)
(Au|À la|Dans le|Sur la|Chez nous, le|Vers la|Pour le|Du|Sous le|Avec la|Sans le|En|Dès le|Depuis le) (bureau|maison|cuisine|jardin|salon|garage|travail|bout|retour|début|fond|prix|soleil|marché|lavage|matin|soir|été|hiver|voyage|mode d'emploi) (il|elle|on|tout|rien|ça|c'est|de|du|et) (marche|casse|tient|va bien|bouge|l'année|mois|plaît|reste|vrai|trop tard|encore)(.|!|, {word}.)|(Les|Des|Mes|Nos|Ces|Quelques|Tous les|Plusieurs|Mamie|Papi|Maman|Papa|Tonton) (enfants|voisins|amis|clients|collègues|vis|boutons|pieds|couleurs|gens|parents|chiens|et moi|aussi|encore) (veulent|aiment|rient|sont|demandent|en|manquent|tiennent|adore|l'utilise) (aussi|un|bien|contents|rouges|encore|tout|cassés|beaucoup|souvent)(.|!|, {small} fois.)|(Puis|Donc|Alors|Mais|Enfin|Ensuite|Parce que|Comme|Quand|Toujours|Jamais|Déjà|Bref|Car|Sinon|Même si|Pourtant|Heureusement) (il|elle|on|ça|tout|c'est|rien|j'ai|nous) (marche|reste|casse|tient|va|vu|pris|mieux|là|dommage|changé|tourne)(.|!|, merci.)
(Im|Am|Zum|Beim|Vom|Ins|Fürs|Übers|Unterm) (Büro|Garten|Keller|Anfang|Ende|Preis|Kauf|Waschen|Kochen|Urlaub|Winter|Sommer|Haus|Test|Wochenende|Auto|Bad|Lieferumfang|Vergleich) (ist|war|steht|läuft|fehlt|gibt|hält|bleibt) (es|er|sie|alles|nichts|das) (gut|da|noch|mehr|stabil|leise|still|schief)(.|!)|(Der|Die|Das|Ein|Unser|Mein|Jeder|Dieser) (Deckel|Stecker|Rahmen|Griff|Koffer|Knopf|Becher|Schlauch|Boden|Sitz|Ständer|Spiegel|Teppich|Bezug|Rand|Korb|Riemen|Stoff) (hat|bekam|braucht|wiegt|misst|kostet) {small} (Watt|Liter|Knöpfe|Taschen|Fächer|Stufen|Gramm|Löcher|Jahre|Kratzer)(.|!)|(Wir|Man|Oma|Opa|Mama|Papa|Kinder|Nachbarn|Freunde|Kollegen|Gäste|Leute) (lachen|lacht|fragen|fragt|sagen|sagt|nutzen|nutzt|mag|mögen|kaufen|wollen|will) (oft|auch|immer|sehr|gern|nie|schon|jetzt) (danach|darüber|eins|den Stuhl|die Lampe|damit|mehr|so etwas)(.|!)|(Dann|Doch|Aber|Also|Leider|Zum Glück|Vielleicht|Eigentlich|Immer|Jetzt|Trotzdem|Sonst|Denn|Weil|Obwohl|Danach|Endlich) (ist|war|geht|kam|riss|brach|hielt|lief|fiel) (der|die|das|er|sie|es) (Knopf|Naht|Bild|Kanne|Rad|Feder|nicht|doch|ab|an|wieder)(.|!| ab.| nicht mehr.)
(Somebody|Nobody|Everyone|Each child|Grandma|Granny|Grandpa|Grandad|Mum|Dad|Mom|Kids|Guests|Friends|Neighbours|Customers|People) (cut|hurt|burned|pinched|stubbed|bruised) (a|the|my|his|her|one) (hand|thumb|elbow|toe|arm|nose)( on| with| at)( the| its| that) {part}(.|!)|(And|But|So|Then|Also|Still|Yet|Even|Maybe|Perhaps|Luckily|Sadly|Honestly|Actually|Anyway|Besides|Otherwise|Meanwhile|Though|Because|If|When|While|After|Before|Until|Unless) (it|they|the {part}|we|you|I|nothing|everything) (is|was|were|works|stopped|broke|did|had|can|went|came|saw) (not|so|still|too|again|just|{word}|back|off|down|well)(.|!|, (really|honestly|sadly|again).)"""

#: Signs that turn up anywhere and mean nothing.
NOISE = ("🙂", "👍🏽", "❤️", "***", "=====", "...", "<p>", "</b>", "[url]", "\u200b", "\ufeff", "&quot;", "٣٤٥", "ﬂ", "~~")


def split_patterns(text: str) -> list[str]:
    """The patterns of a text: its lines, cut at every bar outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text + "\n"):
        depth += (c == "(") - (c == ")")
        if c == "\n" or (c == "|" and not depth):
            out.append(text[at:i])
            at, depth = i + 1, 0
    return out


class _Filler:
    def __init__(self, rng: random.Random) -> None:
        self.r = rng

    def form(self, *shapes: str) -> str:
        """One of the shapes, with each ``9`` a digit and each ``A`` a letter."""
        put = {"9": string.digits, "A": string.ascii_uppercase}
        return "".join(self.r.choice(put[c]) if c in put else c for c in self.r.choice(shapes))

    def syllable(self) -> str:
        return self.r.choice(ONSETS) + self.r.choice(VOWELS)

    def pseudo(self, like: str) -> str:
        """An invented word in the case of ``like``."""
        word = self.syllable() + self.r.choice(CODAS + ["", "nt", "ll"]) + self.r.choice(WORD_ENDS)
        return word.upper() if like.isupper() else word.capitalize() if like[0].isupper() else word

    def given(self) -> str:
        if self.r.random() < 0.45:
            return self.r.choice(GIVEN)
        name = "".join(self.syllable() for _ in range(self.r.choice((1, 1, 2)))) + self.r.choice(CODAS + [""]) + self.r.choice(GIVEN_ENDS)
        return (name if self.r.random() < 0.7 else self.syllable() + self.r.choice(CODAS)).capitalize()

    def plain_family(self) -> str:
        if self.r.random() < 0.4:
            return self.r.choice(FAMILY)
        return (self.syllable() + self.r.choice(CODAS) + self.r.choice(NAME_ENDS) if self.r.random() < 0.6 else self.syllable() + self.r.choice(CODAS + [""]) + self.syllable() + self.r.choice(NAME_ENDS)).capitalize()

    def family(self) -> str:
        f = self.plain_family()
        return self.r.choice((f,) * 16 + (f"O'{f}", f"D'{f}", f"Mc{f}", f"{f}-{self.plain_family()}", f"{f}-{self.plain_family()}", f"van {f}", f"Van {f}", f"De {f}", f"de la {f}", f"von {f}"))

    def person(self) -> str:
        g, f, i = self.given(), self.family(), self.r.choice(string.ascii_uppercase)
        text = self.r.choice((f"{g} {f}",) * 9 + (f"{f}, {g}", f"{g} {i}. {f}", f"{g} {i}. {f}", f"{g[0]}. {f}", f"{g} {self.given()} {f}", f"{g}-{self.given()} {f}", g, g, g))
        return self.r.choice((text,) * 22 + (text.upper(), text.upper(), text.lower() if " " in text else text))

    def cyrillic(self) -> str:
        first = self.r.choice(("Иван", "Анна", "Сергей", "Мария", "Олег", "Елена", "Павел", "Ирина"))
        return f"{first} {self.r.choice(('Иванов', 'Петров', 'Смирнов', 'Соколов', 'Морозов'))}{'' if first[-1] not in 'ая' else 'а'}"

    def email(self) -> str:
        bare = lambda t: re.sub(r"[^a-z]", "", t.lower())
        g, f = bare(self.given()) or "info", bare(self.plain_family()) or "office"
        sep, number = self.r.choice("...__-"), self.r.choice(("",) * 3 + (str(self.r.randint(1, 99)), str(self.r.randint(1, 9999))))
        local = self.r.choice((f"{g}{sep}{f}{number}",) * 5 + (f"{g[0]}{f}{number}", f"{g}{f}{number}", f"{g}{sep}{f[0]}{sep}{f}", f"{g}+{self.r.choice(('news', 'web', 'orders', 'x'))}", f"{f}{number}", g))
        name = self.r.choice(("example", "gmail", "outlook", "yahoo", "mail", "web", "company", "post.example", "mail.example", f"{bare(self.plain_family())}", f"{f}-{self.r.choice(THINGS).split()[0]}"))
        top = self.r.choice(("com", "com", "org", "net", "de", "fr", "es", "co.uk", "io", "test", "example", "info", "eu"))
        style = self.r.random()
        if style < 0.1:
            return f"{local}{self.r.choice((' (at) ', '(at)', ' [at] ', '[at]', ' @ ', ' (AT) '))}{name}{self.r.choice(('.', '.', ' [dot] '))}{top}"
        if style < 0.15:
            return f"{g} dot {f} at {name.replace('.', ' dot ')} dot {top.replace('.', ' dot ')}"
        text = f"{local}@{name}.{top}"
        return self.r.choice((text,) * 9 + (text.upper(), text.title()))

    def phone(self) -> str:
        s = self.r.choice((" ", "-", ".", " - ", " – "))
        return self.form(
            f"999{s}999{s}9999", f"999{s}999{s}9999", "(999) 999-9999", "(999) 999-9999", "(999)999-9999", "9999999999", "+19999999999", "+1 999 999 9999", "1-999-999-9999", "+1-999-999-9999", "999-9999", "999 9999", "999-999-9999 ext. 99",
            "07999 999999", "07999 999 999", "079 9999 9999", "+44 7999 999999", "+44 7999 999 999", "+44 (0)7999 999999", "020 7999 9999", "0199 999 9999",
            "030 99999999", "030 99999 999", "(030) 99999 999", "030/9999999", "0999/999999", "0999-9999999", "+49 30 9999999", "+49 30 99999-999", "+49 (0)30 9999999", "0179 9999999",
            "09 99 99 99 99", "01 99 99 99 99", "01.99.99.99.99", "06-99-99-99-99", "+33 1 99 99 99 99", "+33 6 99 99 99 99", "0199999999",
            "699 999 999", "99 999 99 99", "+34 699 999 999", "+34 99 999 99 99", "+61 9 9999 9999", "+61 499 999 999", "+7 999 999-99-99", "8 (999) 999-99-99", "+81 9-9999-9999", "090-9999-9999", "+86 199 9999 9999", "199 9999 9999", "+971 99 999 9999",
        )

    def identity(self) -> str:
        return self.form("999-99-9999", "999-99-9999", "999-99-9999", "999 99 9999", "999999999", "AA999999A", "AA 99 99 99 A", "AA 99 99 99 A", "A99999999", "AA9999999", "A9999999", "A999-9999-9999", "AAAAA999999AA9AA", "999999999", "9999 9999 9999", "99-9999999")

    def ausweis(self) -> str:
        return self.form("A99AA99A9", "A9AA99999", "A999999999", "A99 999 999", "AA9999999", "A9AAA9999", "99 999 999 999", "99999999999", "99 999999 A 999")

    def dni(self) -> str:
        return self.form("99999999A", "99999999A", "99.999.999-A", "99999999-A", "99 999 999 A", "X9999999A", "Y9999999A", "X-9999999-A", "AAA999999")

    def carte(self) -> str:
        return self.form("999999999999", "9 99 99 99 999 999 99", "9 99 99 99 999 999", "99AA99999", "9999 9999 9999", "999999999999", "9999999999999")

    def street(self) -> str:
        words = [self.r.choice(STREETS) if self.r.random() < 0.5 else (self.syllable() + self.r.choice(CODAS) + self.r.choice(("", self.r.choice(NAME_ENDS)))).capitalize()]
        if self.r.random() < 0.4:
            words.append(self.r.choice(LAND))
        if self.r.random() < 0.08:
            words = [self.r.choice(("1st", "2nd", "3rd", "4th", "5th", "12th", "Second", "Fifth"))]
        if self.r.random() < 0.06:
            words.insert(0, self.r.choice(("St.", "Saint", "Mount", "Fort", "Old", "New")))
        return " ".join(words)

    def address(self) -> str:
        if self.r.random() < 0.15:
            return f"{self.r.choice(('P.O. Box', 'PO Box', 'P. O. Box', 'Post Office Box', 'P.O. BOX', 'POB'))} {self.r.randint(1, 9999)}"
        way = self.r.choice(("",) * 5 + ("N ", "S ", "E ", "W ", "N. ", "S. ", "East ", "West ", "North ", "South "))
        kind = self.r.choice(TYPES)
        text = f"{self.r.randint(1, 9999 if self.r.random() < 0.3 else 400)}{self.r.choice(('',) * 12 + ('A', 'b'))} {way}{self.street()} {kind}{'.' if len(kind) < 5 and self.r.random() < 0.1 else ''}"
        text += self.r.choice(("",) * 5 + (f", Apt {self.r.randint(1, 99)}", f" Apt {self.r.randint(1, 9)}{self.r.choice('ABC')}", f" #{self.r.randint(1, 99)}", f", Unit {self.r.choice(string.ascii_uppercase)}", f", Suite {self.r.randint(1, 400)}", f", Floor {self.r.randint(1, 9)}"))
        text += self.r.choice(("",) * 6 + (f", {self.r.choice(CITIES)}", f", {self.r.choice(CITIES)}, {self.r.choice(STATES)} {self.form('99999')}"))
        return self.r.choice((text,) * 12 + (text.upper(), text.lower()))

    def adresse(self) -> str:
        word = self.r.choice(("Haupt", "Bahnhof", "Garten", "Schul", "Kirch", "Berg", "Wald", "Mühlen", "Ring", "Dorf", "Goethe", "Rosen", "Eichen", "Buchen", "Park", self.plain_family()))
        street = self.r.choice((f"{word}straße", f"{word}str.", f"{word}weg", f"{word}gasse", f"{word}allee", f"{word}ring", f"{word}platz", f"{word}damm", f"{word}strasse", f"Am {word}berg", f"An der {word}brücke", f"Zum {word}hof", f"Alte {word}straße"))
        return f"{street} {self.r.randint(1, 200)}{self.r.choice(('', '', '', 'a', 'b', ' c'))}" + self.r.choice(("", "", f", {self.form('99999')} {self.r.choice(('Neustadt', 'Altdorf', 'Bergheim', 'Waldhausen', 'Köln', 'Ulm'))}"))

    def direccion(self) -> str:
        kind = self.r.choice(("Calle", "C/", "Avenida", "Avda.", "Av.", "Paseo", "Plaza", "Camino", "Ronda", "Calle de", "Calle del", "Avenida de la", "Plaza de las", "Paseo de los", "Travesía de"))
        word = self.r.choice(("Sol", "Luna", "Real", "Constitución", "España", "San Juan", "Santa Ana", "Cervantes", "Goya", "Flores", "Rosas", "Pinos", "Río", "Fuente", "Norte", self.plain_family()))
        return f"{kind} {word}{self.r.choice((' ', ', ', ', nº ', ' nº ', ', n.º '))}{self.r.randint(1, 200)}" + self.r.choice(("", "", f", {self.r.randint(1, 9)}º {self.r.choice('ABCD')}", f", {self.r.randint(1, 9)}ª planta", f", {self.form('99999')} Madrid", ", bajo"))

    def rue(self) -> str:
        kind = self.r.choice(("rue", "rue de", "rue du", "rue des", "avenue", "avenue de", "avenue du", "boulevard", "bd", "place", "place du", "chemin", "chemin des", "allée des", "impasse du", "quai", "Rue", "Rue de la", "Avenue des"))
        word = self.r.choice(("Victor Hugo", "Jean Jaurès", "Gare", "Église", "République", "Moulin", "Château", "Écoles", "Roses", "Pins", "Lac", "Mairie", "Champs", "Molière", self.plain_family(), self.given()))
        return f"{self.r.randint(1, 250)}{self.r.choice((' ', ', ', ' bis ', ' ter ', ' '))}{kind} {word}" + self.r.choice(("", "", "", f", {self.form('99999')} {self.r.choice(('Lille', 'Nantes', 'Dijon', 'Tours'))}"))

    def groups(self) -> str:
        """Groups of digits that are no usual phone or identity number."""
        while True:
            sizes = [self.r.randint(2, 7) for _ in range(self.r.choice((2, 3, 3, 4)))]
            if tuple(sizes) not in ((3, 3, 4), (3, 4), (3, 2, 4), (4, 3, 3), (3, 4, 4), (2, 4, 4)):
                return self.r.choice("---- .").join(self.form("9" * n) for n in sizes)

    def order(self) -> str:
        if self.r.random() < 0.35:
            return self.r.choice(("", "", "", "#", "order ", "no. ", "RMA-")) + self.groups()
        return self.form("#99999", "#9999999", "#99999999", "999-9999999-9999999", "999-9999-99", "9999-9999", "no. 9999999", "no. 999999", "A-99999", "AA-9999-99", "AAA-9999-9999", "RMA 99999", "RMA-999999", "ORD-999999", "99999999", "R9999999", "999.999.999", "order 999-9999999-9999999", "INV-2099-9999", "9999999999", "9999999")

    def serial(self) -> str:
        if self.r.random() < 0.25:
            return self.r.choice(("", "", "", "SN ", "LOT ", self.form("AA-"))) + self.groups()
        return self.form("SN9999999999", "SN 99999999", "S/N 9999-9999", "EAN 9999999999999", "EAN 999999999999", "LOT 9999", "LOT 999 999", "AA-9999", "AA-9999-99", "AA9999", "A9999-AA", "IP99", "99V", "99V/99W", "999-99-99", "AAA999", "AA 99/99", "99AA9", "USB 9.9", "MK9", "9999-AA-99", "ISBN 999-9-99-999999-9", "B09AAA99AA", "ISO 9999", "EN 99999")

    def brand(self) -> str:
        name = self.r.choice((self.plain_family(), self.given(), (self.syllable() + self.syllable()).capitalize(), self.syllable().capitalize() + self.r.choice(("tec", "line", "ware", "lux", "max", "ora", "ix", "ta"))))
        more = self.r.choice(("",) * 4 + (" & Co", " & Sons", " Home", " & Co.", " Brothers", " GmbH", " Inc.", " Tools", " Kitchen", " Sports", f" & {self.plain_family()}", f" {self.r.choice(STREETS)}", " Pro"))
        return name + more

    def item(self) -> str:
        thing, model = self.r.choice(THINGS), self.form("A99", "A999", "A999", "AA99", "999", "9999", "X9", "Pro", "Mini", "Mk9", "9000", "A9")
        return self.r.choice((thing,) * 5 + (f"{self.brand()} {thing}", f"{self.brand()} {thing} {model}", f"{self.brand()} {thing} {model}", f"{self.brand()} {model}", f"{thing} {model}"))

    def price(self) -> str:
        p = f"{self.r.randint(1, 900)}{self.r.choice(('', '.' + self.form('99'), '.' + self.form('99'), ',' + self.form('99')))}"
        return self.r.choice((f"${p}", f"€{p}", f"€ {p}", f"£{p}", f"{p} €", f"{p} EUR", f"{p} USD", f"{p} dollars", f"{p} euros", f"{p}元", f"{p}円", f"${p}"))

    def date(self) -> str:
        y, m, d = self.r.randint(2005, 2030), self.r.randint(1, 12), self.r.randint(1, 28)
        return self.r.choice((f"{y}-{m:02d}-{d:02d}", f"{m}/{d}/{y % 100:02d}", f"{m:02d}/{d:02d}/{y}", f"{d}.{m}.{y}", f"{d:02d}.{m:02d}.{y}", f"{d}/{m}/{y}", f"{y}/{m:02d}/{d:02d}", f"{self.r.choice(('Jan', 'March', 'June', 'October'))} {d}, {y}", f"{d} {self.r.choice(('May', 'July', 'Sept', 'mayo', 'mars'))} {y}"))

    def small(self) -> str:
        return str(self.r.randint(1, 99 if self.r.random() < 0.9 else 900))

    def year(self) -> str:
        return str(self.r.randint(1970, 2030))

    def version(self) -> str:
        return ".".join(str(self.r.randint(0, 60)) for _ in range(self.r.choice((2, 3, 3))))

    def part(self) -> str:
        return self.r.choice(PARTS)

    def word(self) -> str:
        return self.r.choice(WORDS)

    def relative(self) -> str:
        return self.r.choice(RELATIVES)

    def pariente(self) -> str:
        return self.r.choice("madre padre hermana hermano hija hijo abuela abuelo prima tío amiga novio vecina jefe".split())

    def parente(self) -> str:
        return self.r.choice("mère sœur fille tante cousine voisine amie grand-mère femme collègue".split())


#: Slots that are mentions, and the kind of each.
KINDS = {
    "email": "email", "phone": "phone", "identity": "identity_number", "ausweis": "identity_number", "dni": "identity_number", "carte": "identity_number", "person": "person_name", "cyrillic": "person_name",
    "address": "street_address", "adresse": "street_address", "direccion": "street_address", "rue": "street_address",
}

#: Words that may give way to invented ones: Latin letters, three or more.
_WORD = re.compile(r"(?<![\w@.#'/&])[A-Za-zÀ-ÿ]{3,}(?![\w@&]|\.\w)")

_CHOICE = re.compile(r"\(([^()]*\|[^()]*)\)")
_POSITIVE = split_patterns(POSITIVE)
#: Patterns with text that looks like a mention stand three times.
_NEGATIVE = [p for p in split_patterns(NEGATIVE) for _ in range(3 if re.search(r"\{(order|serial|item|brand)\}", p) else 1)]


def sentence(pattern: str, fill: _Filler) -> tuple[str, list[tuple[int, int, str]]]:
    """A text drawn from a pattern, with its mentions."""
    while "(" in pattern:
        drawn = _CHOICE.sub(lambda m: fill.r.choice(m[1].split("|")), pattern)
        if drawn == pattern:
            break
        pattern = drawn
    # Unknown words are to be told by their surroundings: some give way to invented ones.
    share = 0.04 if "{person}" in pattern or "{titled}" in pattern else 0.12
    pieces = re.split(r"(\{\w+\})", pattern)
    pattern = "".join(x if i % 2 else _WORD.sub(lambda m: fill.pseudo(m[0]) if fill.r.random() < share else m[0], x) for i, x in enumerate(pieces))
    if fill.r.random() < 0.1:
        pattern = pattern.replace("{person}", fill.r.choice(TITLES) + " {person}", 1)
    pattern = pattern.replace("{titled}", fill.r.choice(TITLES) + " {person}" if fill.r.random() < 0.6 else "{person}").replace("{contact}", fill.r.choice(("{phone}", "{email}")))
    text, spans = "", []
    for literal, slot, _, _ in string.Formatter().parse(pattern):
        text += literal
        if slot:
            value = getattr(fill, slot)()
            if slot in KINDS:
                spans.append((len(text), len(text) + len(value), KINDS[slot]))
            text += value
    return text, spans


def labelled(size: int, seed: int = 7, positive: list[str] | None = None, negative: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``size`` texts of a few sentences each with their mentions (start, end, kind); other
    patterns than the table's own may be given."""
    rng = random.Random(seed)
    fill = _Filler(rng)
    good, bad = positive or _POSITIVE, negative or _NEGATIVE
    out = []
    for _ in range(size):
        text, spans = "", []
        for _ in range(rng.choice((1, 2, 3))):
            s, marks = sentence(rng.choice(good) if rng.random() < 0.5 else rng.choice(bad), fill)
            if rng.random() < 0.05:
                s += " " + rng.choice(NOISE)
            glue = rng.choice((" ", " ", " ", "\n", "\n\n", "\t", " <br> ", "  ")) if text else ""
            at = len(text) + len(glue)
            text += glue + s
            spans += [(a + at, b + at, k) for a, b, k in marks]
        change = rng.random()
        if change < 0.05 and "'" in text and not spans:
            text = text.replace("'", "&#39;")
        elif change < 0.11 and len(text.upper()) == len(text):
            text = text.upper()
        elif change < 0.17 and len(text.lower()) == len(text):
            text = text.lower()
        elif change < 0.24:
            at = rng.randrange(max(len(text) - 1, 1))
            if text[at : at + 2].isalpha():
                text = text[:at] + text[at + 1 : at + 2] + text[at] + text[at + 2 :]
        out.append((text, spans))
    return out
